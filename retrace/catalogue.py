"""Every query of the reference's own operators over the driver's tables, each with its equivalent in SQL.

The tables are shaped into a history (from ``events``), a log of statements (from ``events``), elements and links
(from ``lineitem``); the shaping is the same in both languages, see HIST.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrace.functions import values as V
from retrace.functions.sqlshape import with_shapes
from retrace.operators import coalesce as C
from retrace.operators import drafts
from retrace.operators import links as L
from retrace.operators import replay as R
from retrace.operators import write as W
from retrace.operators.redact import Rules, redact
from retrace.operators.txlog import fates
from retrace.plans.query import HistoryQuery as Q
from retrace.plans.reader import Reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HIST = """hist AS (SELECT CASE user_id % 3 WHEN 0 THEN 'account' WHEN 1 THEN 'order' ELSE 'cart' END AS objectType, CAST(user_id AS VARCHAR) AS objectId,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'update' END AS event, date_trunc('second', ts) AS moment, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS loggedAt,
  CASE WHEN event_id % 11 = 0 THEN 'system' ELSE 'u-' || CAST(event_id % 5 AS VARCHAR) END AS source, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
  lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old_value, value AS new_value, user_id % 10 AS warehouseId, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type = 'purchase' THEN 'note ' || CAST(event_id % 7 AS VARCHAR) END AS note, CAST(ts AS DATE) AS opDay, event_id AS seq FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "account").when(F.col("user_id") % 3 == 1, "order").otherwise("cart").alias("objectType"), F.col("user_id").cast("string").alias("objectId"),
        F.when(kind == "signup", "create").when(kind == "error", "remove").otherwise("update").alias("event"), F.date_trunc("second", ts).alias("loggedAt"),
        F.when(F.col("event_id") % 11 == 0, "system").otherwise(F.concat(F.lit("u-"), (F.col("event_id") % 5).cast("string"))).alias("source"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("old_value"), F.col("value").alias("new_value"), (F.col("user_id") % 10).alias("warehouseId"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(kind == "purchase", F.concat(F.lit("note "), (F.col("event_id") % 7).cast("string"))).alias("note"), F.to_date(ts).alias("opDay"), F.col("event_id").alias("seq"))


ROUTING = {"order": "orders_log", "cart": "carts_log"}


def reader(spark: SparkSession, sf_dir: str, **options) -> Reader:
    """Three tables by route: orders, carts, and the rest."""
    h = history(spark, sf_dir)
    return Reader({"audit_log": h.where("objectType = 'account'"), "orders_log": h.where("objectType = 'order'"), "carts_log": h.where("objectType = 'cart'")}, ROUTING, **options)


SHOWN = ["objectType", "objectId", "event", "loggedAt", "source", "id"]
SHOWN_SQL = "objectType, objectId, event, loggedAt, source, id"


def shown(df: DataFrame) -> DataFrame:
    return df.select("objectType", "objectId", "event", V.second_text(F.col("loggedAt")).alias("loggedAt"), "source", "id")


def register(name: str, sql: str | None, plain: bool = False):
    """Registers a query under a name; its SQL gets the history as a common table in front."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if plain else f"WITH {HIST} {sql}" if not sql.startswith(",") else f"WITH {HIST}{sql}"
        return f

    return add


def matching(name: str, query: Callable[[], Q], where: str, **options) -> None:
    """A query whose answer is all rows that match, in SQL a WHERE."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = reader(spark, sf_dir, **options)
        return shown(r.matching(r.extended(query())))

    register(name, f"SELECT {SHOWN_SQL} FROM hist WHERE {where}")(run)


D = datetime
matching("filter_object_history", lambda: Q.for_("order").with_object_ids(1, 4, "7"), "objectType = 'order' AND objectId IN ('1', '4', '7')")
matching("filter_events", lambda: Q.for_("cart").with_events("create", "remove"), "objectType = 'cart' AND event IN ('create', 'remove')")
matching("filter_actors", lambda: Q.any().with_actors("system"), "source = 'system'")
matching("filter_ids", lambda: Q.any().with_ids("000000000005", "000000000077", "000000000123"), "id IN ('000000000005', '000000000077', '000000000123')")
matching("filter_between", lambda: Q.any().between(D(2024, 1, 1), D(2024, 1, 9, 12, 0, 0)), "moment >= TIMESTAMP '2024-01-01 00:00:00' AND moment <= TIMESTAMP '2024-01-09 12:00:00'")
matching("filter_between_open_end", lambda: Q.for_("account").between(D(2024, 1, 20), None), "objectType = 'account' AND moment >= TIMESTAMP '2024-01-20 00:00:00'")
matching("where_eq", lambda: Q.for_("order").where("warehouseId", 7), "objectType = 'order' AND warehouseId = 7")
matching("where_replaced", lambda: Q.for_("order").where("warehouseId", 7).where("warehouseId", 4), "objectType = 'order' AND warehouseId = 4")
matching("where_in", lambda: Q.any().where_in("warehouseId", 1, 2, 3).with_events("create"), "warehouseId IN (1, 2, 3) AND event = 'create'")
matching("where_exists", lambda: Q.for_("cart").where_exists("note"), "objectType = 'cart' AND note IS NOT NULL")
matching("where_missing", lambda: Q.for_("cart").where_not_exists("note"), "objectType = 'cart' AND note IS NULL")
matching("where_between", lambda: Q.any().where_between("k", 10, 20), "k BETWEEN 10 AND 20")
matching("where_between_open", lambda: Q.any().where_between("k", None, 5), "k <= 5")
matching("narrow_intersection", lambda: Q.any().with_actors("u-1", "u-2", "u-3").narrow_actors("u-2", "u-3", "u-9").where_in("warehouseId", 1, 2, 3).narrow_in("warehouseId", "2", 3), "source IN ('u-2', 'u-3') AND warehouseId IN (2, 3)")
matching("narrow_contradiction", lambda: Q.for_("order").with_object_ids("1").narrow_object_ids("2"), "false")
matching("narrow_missing", lambda: Q.any().where_not_exists("note").narrow_in("note", "note 1"), "false")
matching("match_nothing", lambda: Q.any().match_nothing(), "false")
matching("visibility_extension", lambda: Q.any().with_events("remove"), "event = 'remove' AND warehouseId IN (1, 2)", extensions=[lambda q: q.narrow_in("warehouseId", 1, 2)])
matching("any_multi_index", lambda: Q.any().where("k", 3), "k = 3")
matching("routed_single_index", lambda: Q.for_("order").where("k", 3), "objectType = 'order' AND k = 3")

ORDERED = "ORDER BY loggedAt {0} NULLS LAST, id {0} NULLS LAST"


@register("page_newest", f"SELECT {SHOWN_SQL} FROM hist WHERE objectType = 'order' AND event = 'update' {ORDERED.format('DESC')} LIMIT 50")
def page_newest(spark, sf_dir):
    return shown(reader(spark, sf_dir).find(Q.for_("order").with_events("update").page(1, 50)).rows)


@register("page_oldest_deep", f"SELECT {SHOWN_SQL} FROM hist {ORDERED.format('ASC')} LIMIT 40 OFFSET 800")
def page_oldest_deep(spark, sf_dir):
    return shown(reader(spark, sf_dir).find(Q.any().oldest_first().page(21, 40)).rows)


@register("keyset_after", f"SELECT {SHOWN_SQL} FROM hist WHERE objectType = 'cart' {ORDERED.format('DESC')} LIMIT 30 OFFSET 30")
def keyset_after(spark, sf_dir):
    r = reader(spark, sf_dir)
    query = Q.for_("cart").page(1, 30)
    return shown(r.find(query.after(r.find(query).next_token)).rows)


@register("export_iterate", f"SELECT {SHOWN_SQL} FROM hist WHERE source = 'u-3' AND event = 'create'")
def export_iterate(spark, sf_dir):
    r = reader(spark, sf_dir)
    return shown(r.matching(r.extended(Q.any().with_actors("u-3").with_events("create"))).orderBy("loggedAt", "id"))


@register("total_hits", "SELECT count(*) AS total FROM hist WHERE warehouseId = 5")
def total_hits(spark, sf_dir):
    return reader(spark, sf_dir).raw(Q.any().where("warehouseId", 5), {"size": 0})["total"]


@register("raw_post_filter_collapse", f"SELECT {SHOWN_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY objectId ORDER BY loggedAt DESC, id DESC) AS r FROM hist WHERE objectType = 'order' AND k >= 2 AND event = 'update') WHERE r = 1 {ORDERED.format('DESC')} LIMIT 20")
def raw_post_filter_collapse(spark, sf_dir):
    return shown(reader(spark, sf_dir).raw(Q.for_("order"), {"query": F.col("k") >= 2, "post_filter": F.col("event") == "update", "collapse": {"field": "objectId"}, "size": 20})["hits"])


@register("hydrate_legacy", f"SELECT id, objectType, objectId, event, loggedAt, source FROM hist WHERE seq % 3 <> 1 UNION ALL SELECT id, objectType, objectId, '' AS event, '1970-01-01 00:00:00' AS loggedAt, source FROM hist WHERE seq % 3 = 1")
def hydrate_legacy(spark, sf_dir):
    from retrace.plans.reader import hydrate

    h = history(spark, sf_dir)
    broken = F.col("seq") % 3 == 1
    old = h.select(F.when(~broken, F.col("id")).alias("id"), F.col("id").alias("_id"), "objectType", "objectId", F.when(~broken, F.col("event")).alias("event"), F.when(~broken, V.second_text(F.col("loggedAt"))).otherwise("no time").alias("loggedAt"), "source")
    return shown(hydrate(old)).select("id", "objectType", "objectId", "event", "loggedAt", "source")


def aggregated(name: str, specs: Callable[[], dict], sql: str, key: str, pick: Callable[[], list] | None = None, query: Callable[[], Q] = Q.any) -> None:
    """One aggregation of a raw body. Specs and columns are made when the query runs, as they may need a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = reader(spark, sf_dir).raw(query(), {"size": 0, "aggs": specs()})["aggregations"][key]
        return out.select(*pick()) if pick else out

    register(name, sql)(run)


N = "count(*) AS doc_count"
aggregated("agg_terms_actor", lambda: {"actor": {"terms": {"field": "source", "size": 4}}}, f"SELECT source AS actor, {N} FROM hist GROUP BY 1 ORDER BY doc_count DESC, actor LIMIT 4", key="actor")
aggregated("agg_terms_nested", lambda: {"kind": {"terms": {"field": "objectType"}, "aggs": {"event": {"terms": {"field": "event", "size": 2}}}}}, f"SELECT kind, event, doc_count FROM (SELECT objectType AS kind, event, {N}, row_number() OVER (PARTITION BY objectType ORDER BY count(*) DESC, event) AS r FROM hist GROUP BY 1, 2) WHERE r <= 2", key="kind>event")
aggregated("agg_multi_terms", lambda: {"pair": {"multi_terms": {"terms": [{"field": "objectType"}, {"field": "event"}], "size": 5}}}, f'SELECT objectType AS "pair_objectType", event AS pair_event, {N} FROM hist GROUP BY 1, 2 ORDER BY doc_count DESC, 1, 2 LIMIT 5', key="pair")
aggregated("agg_rare_terms", lambda: {"object": {"rare_terms": {"field": "objectId", "max_doc_count": 60}}}, f"SELECT objectId AS object, {N} FROM hist GROUP BY 1 HAVING count(*) <= 60", key="object")
aggregated("agg_range", lambda: {"value": {"range": {"field": "new_value", "ranges": [{"to": 20}, {"from": 10, "to": 50}, {"from": 50}]}}}, f"SELECT value, {N} FROM (SELECT unnest([CASE WHEN new_value < 20 THEN '*-20' END, CASE WHEN new_value >= 10 AND new_value < 50 THEN '10-50' END, CASE WHEN new_value >= 50 THEN '50-*' END]) AS value FROM hist) WHERE value IS NOT NULL GROUP BY 1", key="value")
aggregated("agg_date_range", lambda: {"part": {"date_range": {"field": "loggedAt", "ranges": [{"key": "early", "to": "2024-01-10"}, {"key": "late", "from": "2024-01-10"}]}}}, f"SELECT CASE WHEN moment < TIMESTAMP '2024-01-10' THEN 'early' ELSE 'late' END AS part, {N} FROM hist GROUP BY 1", key="part")
aggregated("agg_histogram", lambda: {"bar": {"histogram": {"field": "k", "interval": 7}}}, f"SELECT CAST(floor(k / 7.0) * 7 AS BIGINT) AS bar, {N} FROM hist WHERE k IS NOT NULL GROUP BY 1", key="bar", pick=lambda: [F.col("bar").cast("long").alias("bar"), "doc_count"])
aggregated("agg_date_histogram_day", lambda: {"day": {"date_histogram": {"field": "loggedAt", "calendar_interval": "day"}}}, ", d AS (SELECT CAST(moment AS DATE) AS day, count(*) AS n FROM hist WHERE objectType = 'order' AND warehouseId = 1 AND k = 3 GROUP BY 1) SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS doc_count FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day) g LEFT JOIN d USING (day)", key="day", pick=lambda: [F.date_format("day", "yyyy-MM-dd").alias("day"), "doc_count"], query=lambda: Q.for_("order").where("warehouseId", 1).narrow_in("k", 3))
aggregated("agg_date_histogram_day_all", lambda: {"day": {"date_histogram": {"field": "loggedAt", "calendar_interval": "day"}}}, ", d AS (SELECT CAST(moment AS DATE) AS day, count(*) AS n FROM hist GROUP BY 1) SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS doc_count FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day) g LEFT JOIN d USING (day)", key="day", pick=lambda: [F.date_format("day", "yyyy-MM-dd").alias("day"), "doc_count"])
aggregated("agg_date_histogram_fixed", lambda: {"slot": {"date_histogram": {"field": "loggedAt", "fixed_interval": "6h", "min_doc_count": 1}}}, f"SELECT strftime(time_bucket(INTERVAL 6 HOUR, moment, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS slot, {N} FROM hist GROUP BY 1", key="slot", pick=lambda: [V.second_text(F.col("slot")).alias("slot"), "doc_count"])
aggregated("agg_auto_date_histogram", lambda: {"unit": {"auto_date_histogram": {"field": "loggedAt", "buckets": 40}}}, f"SELECT strftime(CAST(moment AS DATE), '%Y-%m-%d') AS unit, {N} FROM hist GROUP BY 1", key="unit", pick=lambda: [F.date_format("unit", "yyyy-MM-dd").alias("unit"), "doc_count"])
aggregated("agg_filter", lambda: {"by_system": {"filter": {"filter": F.col("source") == "system"}, "aggs": {"highest": {"max": {"field": "k"}}}}}, f"SELECT true AS by_system, {N}, max(k) AS highest FROM hist WHERE source = 'system'", key="by_system")
aggregated("agg_filters_overlap", lambda: {"f": {"filters": {"filters": {"low": F.col("k") < 40, "mid": F.col("k").between(20, 60), "noted": F.col("note").isNotNull()}}}}, f"SELECT f, {N} FROM (SELECT unnest([CASE WHEN k < 40 THEN 'low' END, CASE WHEN k BETWEEN 20 AND 60 THEN 'mid' END, CASE WHEN note IS NOT NULL THEN 'noted' END]) AS f FROM hist) WHERE f IS NOT NULL GROUP BY 1", key="f")
aggregated("agg_missing", lambda: {"without": {"missing": {"field": "note"}}}, f"SELECT true AS without, {N} FROM hist WHERE note IS NULL", key="without")
aggregated("agg_composite_page", lambda: {"page": {"composite": {"size": 12, "after": {"kind": "cart", "warehouse": 4}, "sources": [{"kind": {"terms": {"field": "objectType"}}}, {"warehouse": {"terms": {"field": "warehouseId"}}}]}}}, f"SELECT objectType AS kind, warehouseId AS warehouse, {N} FROM hist WHERE objectType > 'cart' OR (objectType = 'cart' AND warehouseId > 4) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 12", key="page")
aggregated("agg_adjacency_matrix", lambda: {"m": {"adjacency_matrix": {"filters": {"a": F.col("k") < 50, "b": F.col("event") == "update", "c": F.col("warehouseId") < 3}}}}, f"SELECT m, {N} FROM (SELECT unnest([CASE WHEN k < 50 THEN 'a' END, CASE WHEN event = 'update' THEN 'b' END, CASE WHEN warehouseId < 3 THEN 'c' END, CASE WHEN k < 50 AND event = 'update' THEN 'a&b' END, CASE WHEN k < 50 AND warehouseId < 3 THEN 'a&c' END, CASE WHEN event = 'update' AND warehouseId < 3 THEN 'b&c' END]) AS m FROM hist) WHERE m IS NOT NULL GROUP BY 1", key="m")
aggregated("agg_sampler", lambda: {"s": {"sampler": {"shard_size": 100}, "aggs": {"mean": {"avg": {"field": "k"}}}}}, f"SELECT true AS s, {N}, avg(k) AS mean FROM (SELECT * FROM hist ORDER BY loggedAt DESC, id DESC LIMIT 100)", key="s")
aggregated("agg_diversified_sampler", lambda: {"s": {"diversified_sampler": {"field": "objectId", "max_docs_per_value": 2, "shard_size": 60}, "aggs": {"mean": {"avg": {"field": "k"}}}}}, f"SELECT true AS s, {N}, avg(k) AS mean FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY objectId ORDER BY loggedAt DESC, id DESC) AS r FROM hist) WHERE r <= 2 ORDER BY loggedAt DESC, id DESC LIMIT 60)", key="s")
BY = {"terms": {"field": "objectType"}}


def metric(name: str, spec: Callable[[], dict], sql: str, pick: Callable[[], list] | None = None) -> None:
    aggregated(name, lambda: {"kind": {**BY, "aggs": {"m": spec()}}}, f"SELECT objectType AS kind, {N}, {sql} FROM hist GROUP BY 1", key="kind", pick=pick)


def rounded(*names: str) -> Callable[[], list]:
    return lambda: ["kind", "doc_count", *[F.round(n, 6).alias(n) for n in names]]


metric("agg_stats", lambda: {"stats": {"field": "k"}}, "count(k) AS m_count, min(k) AS m_min, max(k) AS m_max, round(avg(k), 6) AS m_avg, CAST(sum(k) AS BIGINT) AS m_sum", lambda: ["kind", "doc_count", "m_count", "m_min", "m_max", F.round("m_avg", 6).alias("m_avg"), "m_sum"])
metric("agg_extended_stats", lambda: {"extended_stats": {"field": "k"}}, "CAST(sum(k * k) AS BIGINT) AS m_sum_of_squares, round(var_pop(k), 6) AS m_variance, round(avg(k) + 2 * stddev_pop(k), 6) AS m_upper, round(avg(k) - 2 * stddev_pop(k), 6) AS m_lower", lambda: ["kind", "doc_count", "m_sum_of_squares", *[F.round(n, 6).alias(n) for n in ("m_variance", "m_upper", "m_lower")]])
metric("agg_value_metrics", lambda: {"sum": {"field": "warehouseId"}}, "CAST(sum(warehouseId) AS BIGINT) AS m")
metric("agg_value_count", lambda: {"value_count": {"field": "note"}}, "count(note) AS m")
metric("agg_cardinality_exact", lambda: {"cardinality": {"field": "objectId", "exact": True}}, "count(DISTINCT objectId) AS m")
metric("agg_percentiles_exact", lambda: {"percentiles": {"field": "k", "exact": True}}, "round(quantile_cont(k, 0.01), 6) AS p1, round(quantile_cont(k, 0.5), 6) AS p50, round(quantile_cont(k, 0.99), 6) AS p99", lambda: ["kind", "doc_count", *[F.round(F.col("m")[i], 6).alias(n) for i, n in ((0, "p1"), (3, "p50"), (6, "p99"))]])
metric("agg_percentile_ranks", lambda: {"percentile_ranks": {"field": "k", "values": [10, 50]}}, "round(avg(CASE WHEN k <= 10 THEN 100.0 ELSE 0 END), 6) AS r10, round(avg(CASE WHEN k <= 50 THEN 100.0 ELSE 0 END), 6) AS r50", lambda: ["kind", "doc_count", F.round(F.col("m")[0], 6).alias("r10"), F.round(F.col("m")[1], 6).alias("r50")])
metric("agg_mad", lambda: {"median_absolute_deviation": {"field": "k"}}, "round(mad(k), 6) AS m", rounded("m"))
metric("agg_boxplot", lambda: {"boxplot": {"field": "k"}}, "min(k) AS m_min, max(k) AS m_max, round(quantile_cont(k, 0.25), 6) AS m_q1, round(quantile_cont(k, 0.5), 6) AS m_q2, round(quantile_cont(k, 0.75), 6) AS m_q3", lambda: ["kind", "doc_count", "m_min", "m_max", *[F.round(n, 6).alias(n) for n in ("m_q1", "m_q2", "m_q3")]])
metric("agg_top_hits", lambda: {"top_hits": {"size": 2, "_source": ["id"]}}, "list_aggregate(list(id ORDER BY loggedAt DESC, id DESC)[1:2], 'string_agg', ',') AS m", lambda: ["kind", "doc_count", F.array_join(F.transform("m", lambda h: h["id"]), ",").alias("m")])
metric("agg_top_metrics", lambda: {"top_metrics": {"metrics": ["k"], "sort": ("id", "desc")}}, "arg_max(k, id) AS m_k")
metric("agg_weighted_avg", lambda: {"weighted_avg": {"value": "k", "weight": "warehouseId"}}, "round(sum(k * warehouseId) / sum(CASE WHEN k IS NOT NULL THEN warehouseId END), 6) AS m", rounded("m"))
metric("agg_scripted_metric", lambda: {"scripted_metric": {"column": F.sum(F.col("k") * 2 + 1)}}, "CAST(sum(k * 2 + 1) AS BIGINT) AS m")
aggregated("agg_string_stats", lambda: {"kind": {**BY, "aggs": {"m": {"string_stats": {"field": "source"}}}}}, f", c AS (SELECT objectType AS kind, unnest(string_split(source, '')) AS ch FROM hist), n AS (SELECT kind, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2), e AS (SELECT kind, -sum(p * log2(p)) AS h FROM (SELECT kind, n / sum(n) OVER (PARTITION BY kind) AS p FROM n) GROUP BY 1) SELECT objectType AS kind, {N}, count(source) AS m_count, CAST(min(length(source)) AS BIGINT) AS m_min_length, CAST(max(length(source)) AS BIGINT) AS m_max_length, round(avg(length(source)), 6) AS m_avg_length, round(any_value(h), 6) AS m_entropy FROM hist JOIN e ON kind = objectType GROUP BY 1", key="kind", pick=lambda: ["kind", "doc_count", "m_count", F.col("m_min_length").cast("long").alias("m_min_length"), F.col("m_max_length").cast("long").alias("m_max_length"), F.round("m_avg_length", 6).alias("m_avg_length"), F.round("m_entropy", 6).alias("m_entropy")])

DAYS = f", days AS (SELECT opDay AS day, {N}, sum(k) AS total FROM hist GROUP BY 1)"
DAY = {"date_histogram": {"field": "loggedAt", "calendar_interval": "day"}}


def pipeline(name: str, kind: str, body: Callable[[], dict], sql: str, columns: Callable[[], list]) -> None:
    aggregated(name, lambda: {"day": {**DAY, "aggs": {"total": {"sum": {"field": "k"}}, "p": {kind: body()}}}}, f"{DAYS} {sql}", key="day", pick=lambda: [F.date_format("day", "yyyy-MM-dd").alias("day"), *columns()])


DAY_SQL = "strftime(day, '%Y-%m-%d') AS day"
pipeline("agg_cumulative_sum", "cumulative_sum", lambda: {"buckets_path": "total"}, f"SELECT {DAY_SQL}, CAST(sum(total) OVER (ORDER BY days.day) AS BIGINT) AS p FROM days", lambda: ["p"])
pipeline("agg_derivative", "derivative", lambda: {"buckets_path": "total"}, f"SELECT {DAY_SQL}, CAST(total - lag(total) OVER (ORDER BY days.day) AS BIGINT) AS p FROM days", lambda: ["p"])
pipeline("agg_serial_diff", "serial_diff", lambda: {"buckets_path": "_count", "lag": 3}, f"SELECT {DAY_SQL}, doc_count - lag(doc_count, 3) OVER (ORDER BY days.day) AS p FROM days", lambda: ["p"])
pipeline("agg_moving_fn", "moving_fn", lambda: {"buckets_path": "total", "window": 3, "fn": "avg"}, f"SELECT {DAY_SQL}, round(avg(total) OVER (ORDER BY days.day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS p FROM days", lambda: [F.round("p", 6).alias("p")])
pipeline("agg_bucket_script", "bucket_script", lambda: {"script": "total * 1.0D / doc_count"}, f"SELECT {DAY_SQL}, round(total * 1.0 / doc_count, 6) AS p FROM days", lambda: [F.round("p", 6).alias("p")])
pipeline("agg_bucket_selector", "bucket_selector", lambda: {"script": F.col("doc_count") > 330}, f"SELECT {DAY_SQL}, doc_count FROM days WHERE doc_count > 330", lambda: ["doc_count"])
pipeline("agg_bucket_sort", "bucket_sort", lambda: {"sort": [("total", "desc")], "from": 1, "size": 4}, f"SELECT {DAY_SQL}, CAST(total AS BIGINT) AS total FROM days ORDER BY days.total DESC, days.day LIMIT 4 OFFSET 1", lambda: ["total"])
pipeline("agg_normalize_percent", "normalize", lambda: {"buckets_path": "total", "method": "percent_of_sum"}, f"SELECT {DAY_SQL}, round(total / sum(total) OVER (), 6) AS p FROM days", lambda: [F.round("p", 6).alias("p")])
pipeline("agg_ks_test", "bucket_count_ks_test", lambda: {"buckets_path": "_count"}, f"SELECT {DAY_SQL}, round(max(abs(a)) OVER (), 6) AS p FROM (SELECT day, sum(doc_count) OVER w / sum(doc_count) OVER () - row_number() OVER w / count(*) OVER () AS a FROM days WINDOW w AS (ORDER BY day))", lambda: [F.round("p_two_sided", 6).alias("p")])
aggregated("agg_stats_bucket", lambda: {"day": {**DAY, "aggs": {"total": {"sum": {"field": "k"}}}}, "of": {"stats_bucket": {"buckets_path": "day>total"}}}, f'{DAYS} SELECT count(total) AS "count", CAST(min(total) AS BIGINT) AS "min", CAST(max(total) AS BIGINT) AS "max", round(avg(total), 6) AS "avg", CAST(sum(total) AS BIGINT) AS "sum" FROM days', key="of", pick=lambda: ["count", "min", "max", F.round("avg", 6).alias("avg"), "sum"])
aggregated("agg_max_bucket", lambda: {"day": DAY, "of": {"max_bucket": {"buckets_path": "day>_count"}}}, f"{DAYS} SELECT max(doc_count) AS value FROM days", key="of")
aggregated("agg_avg_bucket", lambda: {"day": DAY, "of": {"avg_bucket": {"buckets_path": "day>_count"}}}, f"{DAYS} SELECT round(avg(doc_count), 6) AS value FROM days", key="of", pick=lambda: [F.round("value", 6).alias("value")])
aggregated("agg_min_bucket", lambda: {"day": DAY, "of": {"min_bucket": {"buckets_path": "day>_count"}}}, f"{DAYS} SELECT min(doc_count) AS value FROM days", key="of")
aggregated("agg_sum_bucket", lambda: {"day": DAY, "of": {"sum_bucket": {"buckets_path": "day>_count"}}}, f"{DAYS} SELECT CAST(sum(doc_count) AS BIGINT) AS value FROM days", key="of")
aggregated("agg_percentiles_bucket", lambda: {"day": DAY, "of": {"percentiles_bucket": {"buckets_path": "day>_count", "percents": [25, 50]}}}, f"{DAYS} SELECT round(quantile_cont(doc_count, 0.25), 6) AS p25, round(quantile_cont(doc_count, 0.5), 6) AS p50 FROM days", key="of", pick=lambda: [F.round(F.get("value", F.lit(0)), 6).alias("p25"), F.round(F.get("value", F.lit(1)), 6).alias("p50")])

# Coalescing: steps are the history of a day, one frame a day.
PAIR = "struct<pair:boolean,old:string,new:string,raw:string>"


def json_number(x: Column) -> Column:
    """A whole number as JSON text."""
    return F.coalesce(x.cast("long").cast("string"), F.lit("null"))


def steps(spark: SparkSession, sf_dir: str, modulo: int = 3) -> DataFrame:
    """The history as records of one field: values are k modulo a small number, so that they come back often. A third field is context."""
    h = history(spark, sf_dir)
    now = F.col("k") % modulo
    before = F.lag(now).over(Window.partitionBy("objectId").orderBy("seq"))
    pair = lambda a, b: F.struct(F.lit(True).alias("pair"), json_number(a).alias("old"), json_number(b).alias("new"), F.lit(None).cast("string").alias("raw"))
    changes = F.map_from_entries(F.array(F.struct(F.lit("qty"), pair(before, now)), F.struct(F.lit("site"), pair(F.col("warehouseId"), F.col("warehouseId")))))
    attributes = F.map_from_entries(F.array_compact(F.array(F.when(F.col("note").isNotNull(), F.struct(F.lit("note").alias("key"), F.col("note").alias("value"))))))
    return h.select(F.date_format("opDay", "yyyy-MM-dd").alias("frame"), "objectType", "objectId", "event", F.nullif("source", F.lit("u-4")).alias("actor"), "id", "loggedAt", "seq", changes.alias("changes"), attributes.alias("attributes"))


def merged(df: DataFrame) -> DataFrame:
    """A coalesced record as plain columns."""
    side = lambda f, s: F.try_element_at("changes", F.lit(f))[s]
    return df.select("frame", "objectType", "objectId", "event", "actor", "id", side("qty", "old").alias("old"), side("qty", "new").alias("new"), side("site", "new").alias("site"), F.try_element_at("attributes", F.lit("note")).alias("note"))


def coalesce_sql(same: str = "old = new", where: str = "true", select: str = "", modulo: int = 3) -> str:
    return f""", raw AS (SELECT *, strftime(opDay, '%Y-%m-%d') AS frame, nullif(source, 'u-4') AS actor, coalesce(CAST(lag(k % {modulo}) OVER (PARTITION BY objectId ORDER BY seq) AS VARCHAR), 'null') AS o, CAST(k % {modulo} AS VARCHAR) AS n FROM hist),
  b AS (SELECT *, CASE WHEN lag(event) OVER w IS NULL OR lag(event) OVER w = 'remove' OR event = 'remove' OR actor IS DISTINCT FROM lag(actor) OVER w THEN 1 ELSE 0 END AS brk, CASE WHEN lag(event) OVER w IS NULL OR lag(event) OVER w = 'remove' THEN 1 ELSE 0 END AS ep FROM raw WINDOW w AS (PARTITION BY frame, objectType, objectId ORDER BY seq)),
  s AS (SELECT *, sum(brk) OVER w AS seg, sum(ep) OVER w AS epoch FROM b WINDOW w AS (PARTITION BY frame, objectType, objectId ORDER BY seq)),
  f AS (SELECT *, min(seq) OVER (PARTITION BY frame, objectType, objectId, epoch) AS first_touch FROM s),
  m AS (SELECT frame, objectType, objectId, seg, arg_min(event, seq) AS event, min(seq) AS seq, min(first_touch) AS first_touch, arg_min(id, seq) AS id, arg_min(o, seq) AS old, arg_max(n, seq) AS new, bool_or(o <> n) AS moved, any_value(warehouseId) AS site, arg_max(note, seq) FILTER (note IS NOT NULL) AS note FROM f GROUP BY 1, 2, 3, 4),
  a AS (SELECT m.*, f.actor, lead(m.seq) OVER (PARTITION BY m.frame, m.objectType, m.objectId ORDER BY m.seg) AS next_seq, ({same}) AS same FROM m JOIN f ON f.seq = m.seq),
  k AS (SELECT frame, objectType, objectId, event, actor, id, seq, next_seq, first_touch, CASE WHEN event = 'remove' OR NOT (same AND moved) THEN old END AS old, CASE WHEN event = 'remove' OR NOT (same AND moved) THEN new END AS new, CAST(site AS VARCHAR) AS site, note FROM a WHERE event <> 'update' OR NOT same)
  SELECT {select or 'frame, objectType, objectId, event, actor, id, old, new, site, note'} FROM k WHERE {where}"""


@register("coalesce_day", coalesce_sql())
def coalesce_day(spark, sf_dir):
    return merged(C.coalesce_records(steps(spark, sf_dir)))


@register("coalesce_actor_boundary", coalesce_sql(where="event <> 'remove' AND next_seq IS NOT NULL"))
def coalesce_actor_boundary(spark, sf_dir):
    out = C.coalesce_records(steps(spark, sf_dir))
    return merged(out.where((F.col("event") != "remove") & (F.col("place.at") < 2**62)))


@register("coalesce_remove_terminal", coalesce_sql(where="event = 'remove'"))
def coalesce_remove_terminal(spark, sf_dir):
    return merged(C.coalesce_records(steps(spark, sf_dir)).where("event = 'remove'"))


@register("coalesce_drop_returned", coalesce_sql(where="old IS NULL"))
def coalesce_drop_returned(spark, sf_dir):
    return merged(C.coalesce_records(steps(spark, sf_dir))).where("old IS NULL")


@register("coalesce_numeric_null_as_zero", coalesce_sql(same="CASE WHEN old = 'null' THEN '0' ELSE old END = CASE WHEN new = 'null' THEN '0' ELSE new END"))
def coalesce_numeric_null_as_zero(spark, sf_dir):
    return merged(C.coalesce_records(steps(spark, sf_dir), numeric=["qty"]))


@register("coalesce_release_order", coalesce_sql(select="frame, id, CAST(row_number() OVER (PARTITION BY frame ORDER BY CASE WHEN event = 'remove' THEN seq ELSE coalesce(next_seq, 4611686018427387904) END, CASE WHEN event = 'remove' THEN 1 ELSE 0 END, first_touch) AS BIGINT) AS place"))
def coalesce_release_order(spark, sf_dir):
    out = C.coalesce_records(steps(spark, sf_dir))
    return out.select("frame", "id", F.row_number().over(Window.partitionBy("frame").orderBy("place")).cast("long").alias("place"))


@register("coalesce_types", coalesce_sql(where="objectType = 'order'", select="frame, objectId, event, id"))
def coalesce_types(spark, sf_dir):
    return C.coalesce_records(steps(spark, sf_dir), types=["order"]).where("objectType = 'order'").select("frame", "objectId", "event", "id")


@register("coalesce_valve", None)
def coalesce_valve(spark, sf_dir):
    """Frames with more than 100 objects by the fold, the others by windows."""
    return C.coalesce_valved(steps(spark, sf_dir), 100)


@register("coalesce_atomic_overflow", None)
def coalesce_atomic_overflow(spark, sf_dir):
    """Frames that hold and stage more than 20 records at once; what is staged follows from the order, so there is no SQL."""
    return C.fold_frames(steps(spark, sf_dir), 20, atomic=True).where("failure IS NOT NULL").select("frame", "failure")


# Statements: a log made of the events, transactions of 20, every seventh rolled back.
STMTS = "tx AS (SELECT *, event_id // 20 AS tx FROM events), stmts AS (SELECT event_id * 10 + 5 AS seq, tx AS flush, tx % 7 = 0 AS voided, user_id, event_type, value, event_id FROM tx)"


def statements(spark: SparkSession, sf_dir: str, connections: int = 1) -> DataFrame:
    """BEGIN, statements and COMMIT or ROLLBACK per transaction; signup inserts, error deletes, the rest updates a row of ``acct``.

    With several connections, transactions are dealt out to them in turn.
    """
    e = table(spark, sf_dir, "events").withColumn("tx", F.floor(F.col("event_id") / 20))
    kind = F.when(F.col("event_type") == "signup", "INSERT INTO acct (user_id, value) VALUES (?, ?)").when(F.col("event_type") == "error", "DELETE FROM acct WHERE user_id = ?").otherwise("UPDATE acct SET value = ? WHERE user_id = ?")
    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    params = F.when(F.col("event_type") == "signup", F.array(user, value)).when(F.col("event_type") == "error", F.array(user)).otherwise(F.array(value, user))
    nothing = F.lit(None)
    own = e.select("tx", (F.col("event_id") * 10 + 5).alias("seq"), kind.alias("sql"), params.alias("params"), F.col("tx").alias("flush"), F.lit(1).cast("long").alias("affected"))
    ends = e.groupBy("tx").agg((F.min("event_id") * 10).alias("first"), (F.max("event_id") * 10 + 9).alias("last"))
    control = ends.select("tx", F.explode(F.array(F.struct(F.col("first").alias("seq"), F.lit("BEGIN").alias("sql")), F.struct(F.col("last").alias("seq"), F.when(F.col("tx") % 7 == 0, "ROLLBACK").otherwise("COMMIT").alias("sql")))).alias("c"))
    control = control.select("tx", "c.seq", "c.sql", nothing.cast("array<string>").alias("params"), nothing.cast("long").alias("flush"), nothing.cast("long").alias("affected"))
    return own.unionByName(control).select(F.concat(F.lit("c"), (F.col("tx") % connections).cast("string")).alias("connection"), "seq", "sql", "params", "flush", "affected", F.lit(False).alias("failed"), F.lit("statement").alias("kind"), nothing.cast("string").alias("generated_key"))


ACCT = R.Mapped("acct", "account", ("user_id",), (("value", "value"),))
ALWAYS = R.Mapped("acct", "account", ("user_id",), (("value", "value"),), always=("user_id",))


def replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bound statements that stood, and their row states. The log is that of 16 connections, each ordered by itself."""
    log = statements(spark, sf_dir, 16)
    stood = fates(log).where("fate = 'COMMITTED'").select("connection", "seq")
    live = with_shapes(log.where("flush IS NOT NULL")).join(stood, ["connection", "seq"])
    rows = R.bound(live, R.mapping_table(spark, [ACCT]))
    return rows, R.row_states(rows.where("binding = 'ROW'"))


@register("tx_fate", f"WITH {STMTS} SELECT seq, CASE WHEN voided THEN 'VOID' ELSE 'COMMITTED' END AS fate, flush AS owner FROM stmts", plain=True)
def tx_fate(spark, sf_dir):
    return fates(statements(spark, sf_dir, 4)).select("seq", "fate", "owner")


@register("tx_savepoints", f"WITH {STMTS}, n AS (SELECT *, count(*) OVER (PARTITION BY flush) = 20 AS whole, event_id % 20 AS i FROM stmts) SELECT seq, CASE WHEN voided OR whole AND flush % 3 = 0 AND i BETWEEN 5 AND 11 THEN 'VOID' ELSE 'COMMITTED' END AS fate, flush AS owner FROM n", plain=True)
def tx_savepoints(spark, sf_dir):
    """Each full transaction sets a savepoint twice under one name; every third goes back to the inner one and on from there, every seventh is rolled back."""
    log = statements(spark, sf_dir, 4)
    full = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("tx")).groupBy("tx").agg(F.count("*").alias("n")).where("n = 20")
    at = lambda i, sql: F.struct((F.col("tx") * 200 + i * 10).alias("seq"), sql.alias("sql"))
    marks = full.select("tx", F.explode(F.array(at(2, F.lit("SAVEPOINT sp")), at(5, F.lit("SAVEPOINT sp")), at(12, F.when(F.col("tx") % 3 == 0, "ROLLBACK TO SAVEPOINT sp").otherwise("RELEASE SAVEPOINT sp")))).alias("m"))
    marks = marks.select(F.concat(F.lit("c"), (F.col("tx") % 4).cast("string")).alias("connection"), "m.seq", "m.sql", F.lit(None).cast("array<string>").alias("params"), F.lit(None).cast("long").alias("flush"), F.lit(None).cast("long").alias("affected"), F.lit(False).alias("failed"), F.lit("statement").alias("kind"), F.lit(None).cast("string").alias("generated_key"))
    return fates(log.unionByName(marks)).where("owner IS NOT NULL").select("seq", "fate", "owner")


REPLAY = f"""WITH {STMTS}, live AS (SELECT * FROM stmts WHERE NOT voided),
  st AS (SELECT *, last_value(CASE event_type WHEN 'signup' THEN 'there' WHEN 'error' THEN 'gone' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS life FROM live),
  v AS (SELECT *, lag(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id, life ORDER BY seq) AS old FROM st WHERE event_type = 'signup' OR before = 'there')"""


@register("replay_row_facts", f"{REPLAY} SELECT seq, flush, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS statement, CASE WHEN event_type <> 'signup' THEN old END AS old, CASE WHEN event_type <> 'error' THEN value END AS new FROM v WHERE event_type <> 'error' AND (event_type = 'signup' OR old <> value) OR event_type = 'error'", plain=True)
def replay_row_facts(spark, sf_dir):
    _, states = replayed(spark, sf_dir)
    out = R.field_changes(states).where("column = 'value'")
    return out.select("seq", "flush", "key", "statement", F.when(F.col("statement") != "INSERT", F.col("old").cast("double")).alias("old"), F.col("new").cast("double").alias("new"))


@register("replay_records", f"{REPLAY} SELECT seq, flush, CAST(user_id AS VARCHAR) AS objectId, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'update' END AS event FROM v WHERE event_type IN ('signup', 'error') OR old <> value", plain=True)
def replay_records(spark, sf_dir):
    _, states = replayed(spark, sf_dir)
    return R.records(R.field_changes(states)).select("seq", "flush", "objectId", "event")


@register("replay_context", f"{REPLAY} SELECT seq, CAST(user_id AS VARCHAR) AS \"objectId\", CAST(user_id AS VARCHAR) AS owner, value FROM v WHERE event_type = 'signup' OR event_type <> 'error' AND old <> value", plain=True)
def replay_context(spark, sf_dir):
    """Records with the user as a field that is always recorded, as the row's image had it, among images of another type with the same keys."""
    _, states = replayed(spark, sf_dir)
    images = R.versions(states)
    other = images.withColumn("objectType", F.lit("cart")).withColumn("root", F.lit("carts")).withColumn("row", F.create_map(F.lit("user_id"), F.lit("wrong")))
    out = drafts.with_context(R.records(R.field_changes(states)), images.unionByName(other), drafts.always_of([ALWAYS]))
    new = lambda c: F.try_element_at("changes", F.lit(c))["new"]
    return out.where("event <> 'remove'").select("seq", "objectId", new("user_id").alias("owner"), new("value").cast("double").alias("value"))


@register("executions", "WITH s AS (SELECT user_id % 4 AS c, event_id, event_id // 20 AS flush, user_id % 2 AS key, event_id % 2 AS root FROM events), b AS (SELECT *, CASE WHEN lag(key) OVER w = key AND lag(flush) OVER w = flush AND lag(root) OVER w <> root THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY c ORDER BY event_id)) SELECT 'c' || c AS connection, event_id AS seq, CAST(sum(brk) OVER (PARTITION BY c ORDER BY event_id) AS BIGINT) AS execution FROM b", plain=True)
def executions(spark, sf_dir):
    """Statements on two tables of one hierarchy: neighbours on one object, of one flush and on different tables, are one execution."""
    e = table(spark, sf_dir, "events")
    return R.executions(e.select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("connection"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 20).alias("flush"), F.lit("oven").alias("objectType"), (F.col("user_id") % 2).cast("string").alias("key"), F.lit("UPDATE").alias("statement"), (F.col("event_id") % 2).cast("string").alias("root"))).select("connection", "seq", "execution")


@register("replay_doubts", f"{REPLAY} SELECT seq, flush, 'the row was not known' AS text FROM st WHERE event_type <> 'signup' AND before IS NULL", plain=True)
def replay_doubts(spark, sf_dir):
    rows, states = replayed(spark, sf_dir)
    return R.doubts(rows, states).select("seq", "flush", "text")


@register("replay_versions", f"{REPLAY} SELECT CAST(user_id AS VARCHAR) AS key, seq AS valid_from, next AS valid_to, value FROM (SELECT *, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS next FROM st WHERE event_type = 'signup' OR before = 'there') WHERE event_type <> 'error'", plain=True)
def replay_versions(spark, sf_dir):
    _, states = replayed(spark, sf_dir)
    return R.versions(states).select("key", "valid_from", "valid_to", F.element_at("row", "value").cast("double").alias("value"))


# Elements and links: lines of an order, and the suppliers it has.
ELEMS = "el AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linenumber) AS seq FROM lineitem), ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq) AS r FROM el)"


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements on lines: the first of a line inserts it, later ones set its quantity. Each order is a connection of its own, so no order meets another."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("seq")))


def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_log(spark, sf_dir)
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    set_ = F.when(F.col("r") == 1, F.create_map(F.lit("order_id"), F.col("l_orderkey").cast("string"), F.lit("quantity"), F.col("l_quantity").cast("string"))).otherwise(F.create_map(F.lit("quantity"), F.col("l_quantity").cast("string")))
    return R.row_states(rows.select(
        F.col("l_orderkey").cast("string").alias("connection"), "seq", F.lit(None).cast("long").alias("flush"), F.lit(1).cast("long").alias("affected"), F.lit("line").alias("root"), F.lit("line").alias("objectType"), F.create_map(F.lit("quantity"), F.lit("quantity")).alias("fields"), F.array().cast("array<string>").alias("always"),
        F.lit("order_id").alias("owner_key"), F.lit("lines").alias("collection"), F.lit("order").alias("owner_type"), F.when(F.col("r") == 1, "INSERT").otherwise("UPDATE").alias("statement"), line.alias("key"), set_.alias("set")))


@register("element_field_changes", f"WITH {ELEMS}, c AS (SELECT *, lag(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq) AS o FROM ln) SELECT CAST(l_orderkey AS VARCHAR) AS objectId, 'lines.' || l_orderkey || '|' || l_linenumber || '.quantity' AS name, o AS old, l_quantity AS new FROM c WHERE o <> l_quantity", plain=True)
def element_field_changes(spark, sf_dir):
    out = R.element_changes(R.field_changes(line_states(spark, sf_dir)))
    return out.where("name LIKE '%.quantity'").select("objectId", "name", F.col("old").cast("double").alias("old"), F.col("new").cast("double").alias("new"))


@register("element_membership", f"WITH {ELEMS} SELECT CAST(l_orderkey AS VARCHAR) AS objectId, 'lines.' || l_orderkey || '|' || l_linenumber AS name, CAST(NULL AS VARCHAR) AS old, l_orderkey || '|' || l_linenumber AS new FROM ln WHERE r = 1", plain=True)
def element_membership(spark, sf_dir):
    out = R.element_changes(R.field_changes(line_states(spark, sf_dir)))
    return out.where("name NOT LIKE '%.quantity'").select("objectId", "name", "old", "new")


def link_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as links: each line toggles its supplier; a flush is a year of shipping."""
    rows = line_log(spark, sf_dir)
    toggle = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("seq"))
    return rows.select(F.lit("order_supplier").alias("association"), F.col("l_orderkey").cast("string").alias("owner"), "seq", F.year("l_shipdate").cast("long").alias("flush"), F.when(toggle % 2 == 1, "add").otherwise("remove").alias("kind"), F.col("l_suppkey").cast("string").alias("target"), F.lit(None).cast("boolean").alias("observed"))


@register("link_runs", f"""WITH RECURSIVE {ELEMS}, s AS (SELECT l_orderkey, seq, year(l_shipdate) AS flush, l_suppkey AS t, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY seq) AS n FROM el),
  r AS (SELECT l_orderkey, seq, flush, t, 0 AS run, [t] AS met, CAST([] AS BIGINT[]) AS before, [t] AS held FROM s WHERE seq = 1
    UNION ALL SELECT l_orderkey, seq, flush, t, CASE WHEN fresh THEN run + 1 ELSE run END, CASE WHEN fresh THEN [t] ELSE list_append(met, t) END, CASE WHEN fresh THEN held ELSE before END, CASE WHEN list_contains(held, t) THEN list_filter(held, lambda x: x <> t) ELSE list_append(held, t) END
      FROM (SELECT s.l_orderkey, s.seq, s.flush, s.t, r.run, r.met, r.before, r.held, s.flush <> r.flush OR list_contains(r.met, s.t) AS fresh FROM r JOIN s ON s.l_orderkey = r.l_orderkey AND s.seq = r.seq + 1))
  SELECT CAST(l_orderkey AS VARCHAR) AS owner, any_value(flush) AS flush, min(seq) AS since, run, array_to_string(list_sort(arg_max(before, seq)), ',') AS old, array_to_string(list_sort(arg_max(held, seq)), ',') AS new FROM r GROUP BY l_orderkey, run""", plain=True)
def link_runs(spark, sf_dir):
    """Runs by the account fold, from empty accounts."""
    steps_ = link_steps(spark, sf_dir)
    accounts = steps_.select("association", "owner", F.array().cast("array<string>").alias("targets")).distinct()
    return L.runs_of(steps_, accounts).select("owner", "flush", "since", "run", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


@register("element_runs", f"""WITH RECURSIVE {ELEMS}, s AS (SELECT l_orderkey, year(l_shipdate) AS flush, seq, 'lines.' || l_linenumber AS name, row_number() OVER (PARTITION BY l_orderkey, year(l_shipdate) ORDER BY seq) AS n FROM el),
  r AS (SELECT *, 1 AS run, [name] AS met FROM s WHERE n = 1
    UNION ALL SELECT s.*, CASE WHEN list_contains(met, s.name) THEN run + 1 ELSE run END, CASE WHEN list_contains(met, s.name) THEN [s.name] ELSE list_append(met, s.name) END FROM r JOIN s ON s.l_orderkey = r.l_orderkey AND s.flush = r.flush AND s.n = r.n + 1)
  SELECT CAST(l_orderkey AS VARCHAR) AS "objectId", flush, run, min(seq) AS since, string_agg(name, ',' ORDER BY name) AS names FROM r GROUP BY l_orderkey, flush, run""", plain=True)
def element_runs(spark, sf_dir):
    """Changes of lines as runs of their order: a line met again begins the next run. A flush is a year of shipping."""
    rows = line_log(spark, sf_dir)
    changes = rows.select(F.lit("order").alias("objectType"), F.col("l_orderkey").cast("string").alias("objectId"), F.year("l_shipdate").cast("long").alias("flush"), "seq", F.concat(F.lit("lines."), F.col("l_linenumber").cast("string")).alias("name"), F.lit(None).cast("string").alias("old"), F.col("l_quantity").cast("string").alias("new"))
    return drafts.element_runs(changes).select("objectId", "flush", "run", "since", F.array_join(F.array_sort(F.map_keys("changes")), ",").alias("names"))


@register("link_net_changes", f"""WITH {ELEMS}, t AS (SELECT *, CAST(l_suppkey AS VARCHAR) AS target, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY seq) AS n, year(l_shipdate) AS flush FROM el),
  p AS (SELECT l_orderkey, flush, target, arg_min(n, seq) % 2 = 0 AS before, arg_max(n, seq) % 2 = 1 AS after FROM t GROUP BY 1, 2, 3)
  SELECT CAST(l_orderkey AS VARCHAR) AS owner, flush, coalesce(string_agg(target, ',' ORDER BY CAST(target AS BIGINT)) FILTER (before), '') AS old, coalesce(string_agg(target, ',' ORDER BY CAST(target AS BIGINT)) FILTER (after), '') AS new FROM p WHERE before <> after GROUP BY 1, 2""", plain=True)
def link_net_changes(spark, sf_dir):
    out = L.net_links(link_steps(spark, sf_dir))
    return out.select("owner", "flush", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


@register("asof_representation", "WITH f AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id FROM events WHERE event_type = 'error') SELECT p.event_id AS seq, p.user_id AS user_id, f.value AS shown FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.event_id >= f.event_id", plain=True)
def asof_representation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("since"), F.col("value").alias("shown"))
    probes = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("seq"))
    return R.as_of(probes, facts, ["user_id"], "seq", "since", ["shown"]).select("seq", "user_id", "shown")


@register("asof_before_removal", "WITH f AS (SELECT user_id, event_id, value FROM events WHERE event_type IN ('purchase', 'error')), p AS (SELECT user_id, event_id FROM events WHERE event_type = 'error') SELECT p.event_id AS seq, f.value AS shown FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.event_id > f.event_id", plain=True)
def asof_before_removal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = e.where("event_type IN ('purchase', 'error')").select("user_id", F.col("event_id").alias("since"), F.col("value").alias("shown"))
    probes = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("seq"))
    return R.as_of(probes, facts, ["user_id"], "seq", "since", ["shown"], strictly=True).select("seq", "shown")


@register("execution_islands", "WITH b AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS brk FROM conversations), s AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM b) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM s GROUP BY 1, 2", plain=True)
def execution_islands(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("brk", (~F.col("role").eqNullSafe(F.lag("role").over(own))).cast("int"))
    return c.withColumn("run", F.sum("brk").over(own)).groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


# The write path.
def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as records to write: every third without an actor, attributes as JSON text, one change."""
    h = history(spark, sf_dir)
    pair = F.struct(F.lit(True).alias("pair"), F.coalesce(F.col("old_value").cast("string"), F.lit("null")).alias("old"), F.col("new_value").cast("string").alias("new"), F.lit(None).cast("string").alias("raw"))
    attributes = F.map_filter(F.create_map(F.lit("warehouseId"), F.col("warehouseId").cast("string"), F.lit("note"), F.concat(F.lit('"'), F.col("note"), F.lit('"'))), lambda k, v: v.isNotNull())
    return h.select("objectType", "objectId", "event", "loggedAt", F.when(F.col("seq") % 3 > 0, F.col("source")).alias("source"), F.lit(None).cast("string").alias("id"), "seq", F.create_map(F.lit("value"), pair).alias("changes"), attributes.alias("attributes"), F.col("old_value"), F.col("new_value"))


@register("complete_fallback_actor", "SELECT seq, objectType, CASE WHEN seq % 3 > 0 THEN source ELSE 'nobody' END AS source FROM hist")
def complete_fallback_actor(spark, sf_dir):
    return W.Writer(fallback_actor="nobody").complete(written(spark, sf_dir), "run").select("seq", "objectType", "source")


@register("ids_in_order", "SELECT seq, strftime(moment, '%Y-%m-%d %H:%M:%S') AS loggedAt, true AS ordered, true AS version FROM hist")
def ids_in_order(spark, sf_dir):
    """Ids of version 7 that sort as time and order do."""
    out = W.with_ids(written(spark, sf_dir), "run").select("seq", "loggedAt", "id")
    before = F.lag("id").over(Window.partitionBy("loggedAt").orderBy("seq"))
    at = F.conv(F.substring(F.replace("id", F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long") == F.unix_millis("loggedAt")
    return out.select("seq", V.second_text(F.col("loggedAt")).alias("loggedAt"), (F.coalesce(before < F.col("id"), F.lit(True)) & at).alias("ordered"), F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("version"))


@register("enrich_net_delta", "SELECT seq, CASE WHEN old_value IS NOT NULL AND objectType = 'order' THEN round(new_value - old_value, 6) END AS delta FROM hist")
def enrich_net_delta(spark, sf_dir):
    delta = (F.col("new_value") - F.col("old_value")).cast("string")
    writer = W.Writer(enrichers=[W.Enricher({"delta": delta}, types=("order",), merged=True)])
    return writer.prepare(writer.complete(written(spark, sf_dir), "run")).select("seq", F.round(F.try_element_at("attributes", F.lit("delta")).cast("double"), 6).alias("delta"))


@register("redact_changes", "SELECT seq, CASE WHEN objectType = 'cart' THEN '\"***\"' ELSE CAST(new_value AS VARCHAR) END AS new, CASE WHEN old_value IS NULL THEN 'null' WHEN objectType = 'cart' THEN '\"***\"' ELSE CAST(old_value AS VARCHAR) END AS old FROM hist")
def redact_changes(spark, sf_dir):
    out = redact(written(spark, sf_dir), Rules(("cart.value",)))
    side = lambda s: F.element_at("changes", "value")[s]
    return out.select("seq", side("new").alias("new"), side("old").alias("old"))


@register("redact_attribute_removed", "SELECT seq, CAST(NULL AS VARCHAR) AS note, CAST(warehouseId AS VARCHAR) AS warehouse FROM hist")
def redact_attribute_removed(spark, sf_dir):
    out = redact(written(spark, sf_dir), Rules(("note",)))
    return out.select("seq", F.try_element_at("attributes", F.lit("note")).alias("note"), F.try_element_at("attributes", F.lit("warehouseId")).alias("warehouse"))


@register("redact_free_text", "SELECT doc_id, CASE WHEN text = '' THEN '\"\"' ELSE '\"***\"' END AS body FROM documents", plain=True)
def redact_free_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    change = F.struct(F.lit(False).alias("pair"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.concat(F.lit('"'), F.regexp_replace("text", r'["\\\n\t]', " "), F.lit('"')).alias("raw"))
    out = redact(d.select("doc_id", F.lit("document").alias("objectType"), F.create_map(F.lit("post.body"), change).alias("changes"), F.create_map().cast("map<string,string>").alias("attributes")), Rules(("body",)))
    return out.select("doc_id", F.element_at("changes", "post.body")["raw"].alias("body"))


@register("route_index_counts", "SELECT CASE objectType WHEN 'order' THEN 'orders_log' WHEN 'cart' THEN 'carts_log' ELSE 'audit_log' END AS route, count(*) AS n FROM hist GROUP BY 1")
def route_index_counts(spark, sf_dir):
    return W.Writer(routing=ROUTING).routed(written(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@register("rejected_records", "SELECT seq, CASE WHEN seq % 50 = 0 THEN 'no event' ELSE 'an attribute has the name of a field' END AS reason FROM hist WHERE seq % 50 = 0 OR seq % 77 = 0")
def rejected_records(spark, sf_dir):
    bad = written(spark, sf_dir).withColumn("event", F.when(F.col("seq") % 50 != 0, F.col("event"))).withColumn("attributes", F.when(F.col("seq") % 77 == 0, F.create_map(F.lit("source"), F.lit("1"))).otherwise(F.col("attributes")))
    return W.Writer().split(bad)[1].select("seq", "reason")


@register("document_projection", "SELECT seq, objectType, strftime(moment, '%Y-%m-%d %H:%M:%S') AS loggedAt, '2030-01-01 00:00:00' AS writtenAt, warehouseId, CASE WHEN note IS NOT NULL THEN '\"' || note || '\"' END AS note FROM hist")
def document_projection(spark, sf_dir):
    h = written(spark, sf_dir).withColumn("id", F.col("seq").cast("string"))
    out = W.documents(h, {"warehouseId": "long"}, F.lit("2030-01-01").cast("timestamp"))
    return out.select(F.col("id").cast("long").alias("seq"), "objectType", V.second_text(F.col("loggedAt")).alias("loggedAt"), V.second_text(F.col("writtenAt")).alias("writtenAt"), "warehouseId", F.try_element_at("attributes", F.lit("note")).alias("note"))


@register("late_publication_gap", "SELECT id, CAST(k * 100 AS BIGINT) AS gap FROM hist WHERE k * 100 > 3600")
def late_publication_gap(spark, sf_dir):
    h = history(spark, sf_dir).withColumn("writtenAt", F.timestamp_seconds(F.unix_timestamp("loggedAt") + F.col("k") * 100))
    return W.late_publication(h, 3600).select("id", "gap")


@register("retention_delete", f"SELECT {SHOWN_SQL} FROM hist WHERE NOT (moment < TIMESTAMP '2024-01-15' AND objectType IN ('cart', 'order'))")
def retention_delete(spark, sf_dir):
    return shown(W.retained(history(spark, sf_dir), F.lit("2024-01-15").cast("timestamp"), ("cart", "order")))


@register("erasure_pseudonymise", "SELECT seq, CASE WHEN seq % 3 > 0 AND source = 'u-2' THEN 'gone-1' WHEN seq % 3 > 0 THEN source END AS source, CASE WHEN seq % 3 > 0 AND source = 'u-2' THEN 0 ELSE 1 END AS kept FROM hist")
def erasure_pseudonymise(spark, sf_dir):
    return W.forgotten(written(spark, sf_dir), "u-2", "gone-1").select("seq", "source", F.size("changes").alias("kept"))


@register("decorate_actor_name", f"SELECT h.id, c_name AS actor_name FROM (SELECT * FROM hist WHERE objectType = 'order' {ORDERED.format('DESC')} LIMIT 100) h LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = h.objectId")
def decorate_actor_name(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("objectId"), F.col("c_name").alias("actor_name"))
    r = reader(spark, sf_dir, decorators=[lambda rows: rows.join(names, "objectId", "left")])
    return r.decorated(r.find(Q.for_("order").page(1, 100))).select("id", "actor_name")


@register("numeric_spelling", "SELECT event_id, true AS same FROM events", plain=True)
def numeric_spelling(spark, sf_dir):
    """1e2, 100, 100.00 and \"100\" are one number."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    shapes = [n, F.concat(n, F.lit(".000")), F.concat(F.lit('"'), n, F.lit('"')), F.concat(n, F.lit("e0")), F.concat(n, F.lit("00E-2"))]
    same = F.lit(True)
    for s in shapes[1:]:
        same = same & V.null_as_zero(shapes[0], s)
    return e.select("event_id", same.alias("same"))


@register("schema_check", None)
def schema_check(spark, sf_dir):
    """What a table of the history lacks against a declared one."""
    from retrace.sources.schema import TableDefinition, compare

    d = compare(TableDefinition("audit_log", {"warehouseId": "long", "note": "string"}).schema(), history(spark, sf_dir).schema)
    rows = [("missing", p, t) for p, t in sorted(d.missing.items())] + [("mismatched", p, f"{a} is expected, {b} found") for p, (a, b) in sorted(d.mismatched.items())]
    return spark.createDataFrame(rows, "problem string, path string, detail string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements to records, merged by day, counted by actor: ``day, actor, records``."""
    _, states = replayed(spark, sf_dir)
    records = R.records(R.field_changes(states))
    at = table(spark, sf_dir, "events").select((F.col("event_id") * 10 + 5).alias("seq"), F.col("ts").cast("timestamp").alias("loggedAt"), F.when(F.col("event_id") % 11 == 0, "system").otherwise(F.concat(F.lit("u-"), (F.col("event_id") % 5).cast("string"))).alias("actor"))
    steps_ = records.join(at, "seq").withColumn("frame", F.date_format("loggedAt", "yyyy-MM-dd")).withColumn("id", F.lpad(F.col("seq").cast("string"), 12, "0")).withColumn("attributes", F.create_map().cast("map<string,string>"))
    return C.coalesce_records(steps_).groupBy(F.col("frame").alias("day"), "actor").agg(F.count("*").alias("records"))


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = f"""{REPLAY},
  raw AS (SELECT v.seq, v.user_id, CASE v.event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'update' END AS event, CASE WHEN v.event_id % 11 = 0 THEN 'system' ELSE 'u-' || CAST(v.event_id % 5 AS VARCHAR) END AS actor,
    strftime(ts, '%Y-%m-%d') AS day, CASE WHEN v.event_type = 'signup' THEN 'null' ELSE CAST(old AS VARCHAR) END AS o, CAST(v.value AS VARCHAR) AS n FROM v JOIN events ON events.event_id = v.event_id WHERE v.event_type IN ('signup', 'error') OR old <> v.value),
  b AS (SELECT *, CASE WHEN lag(event) OVER w IS NULL OR lag(event) OVER w = 'remove' OR event = 'remove' OR actor <> lag(actor) OVER w THEN 1 ELSE 0 END AS brk FROM raw WINDOW w AS (PARTITION BY day, user_id ORDER BY seq)),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY day, user_id ORDER BY seq) AS seg FROM b),
  m AS (SELECT day, arg_min(actor, seq) AS actor, arg_min(event, seq) AS event, arg_min(o, seq) AS o, arg_max(n, seq) AS n FROM s GROUP BY day, user_id, seg)
  SELECT day, actor, count(*) AS records FROM m WHERE event <> 'update' OR o <> n GROUP BY 1, 2"""
