"""Aggregations: buckets, metrics inside them, and pipelines over the bucketed result.

A body of specs becomes one DataFrame per level: the keys of the path, doc_count, and a column per metric. The
semantics of a document store are kept (top terms by count then key, half-open ranges, empty histogram
buckets) and the work is Catalyst's: one groupBy per level, windows for pipelines.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.errors import InvalidQuery

BUCKETS = {"terms", "multi_terms", "rare_terms", "range", "date_range", "ip_range", "histogram", "date_histogram", "auto_date_histogram", "variable_width_histogram", "filter", "filters", "missing", "nested", "reverse_nested", "composite", "sampler", "diversified_sampler", "adjacency_matrix"}
METRICS = {"avg", "min", "max", "sum", "value_count", "stats", "extended_stats", "cardinality", "percentiles", "percentile_ranks", "median_absolute_deviation", "boxplot", "top_hits", "top_metrics", "scripted_metric", "string_stats", "weighted_avg", "geo_bounds", "geo_centroid"}
PIPELINES = {"avg_bucket", "min_bucket", "max_bucket", "sum_bucket", "stats_bucket", "extended_stats_bucket", "percentiles_bucket", "cumulative_sum", "derivative", "serial_diff", "moving_fn", "moving_percentiles", "bucket_script", "bucket_selector", "bucket_sort", "normalize", "bucket_count_ks_test"}
REFUSED = {"global", "significant_terms", "significant_text", "children", "parent", "inference"}
DEFAULT_PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
CALENDAR = {"minute": "minute", "hour": "hour", "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def check_aggregations(specs: Any) -> None:
    """Refuses what is unknown, looks outside the boundary, or has no form; recursively."""
    if not isinstance(specs, Mapping):
        raise InvalidQuery("aggregations are a map")
    for name, spec in specs.items():
        if not isinstance(spec, Mapping):
            raise InvalidQuery(f"the aggregation {name} is no map")
        kinds = [k for k in spec if k not in ("aggs", "aggregations", "meta")]
        for kind in kinds:
            if kind not in BUCKETS | METRICS | PIPELINES:
                raise InvalidQuery(f"the aggregation {kind} is not allowed" + (": it looks outside the query or needs a model" if kind in REFUSED else ""))
        if len(kinds) != 1:
            raise InvalidQuery(f"the aggregation {name} has no kind, or two")
        for key in ("aggs", "aggregations"):
            if key in spec:
                check_aggregations(spec[key])


def split(spec: Mapping[str, Any]) -> tuple[str, Mapping[str, Any], Mapping[str, Any]]:
    kind = next(k for k in spec if k not in ("aggs", "aggregations", "meta"))
    return kind, spec[kind], spec.get("aggs", spec.get("aggregations", {}))


def aggregate(df: DataFrame, specs: Mapping[str, Any]) -> dict[str, DataFrame]:
    """Every aggregation of a body: name to DataFrame, nested ones as outer>inner."""
    check_aggregations(specs)
    out: dict[str, DataFrame] = {}
    kinds = {name: split(spec)[0] for name, spec in specs.items()}
    metrics = {n: specs[n] for n, k in kinds.items() if k in METRICS}
    for name, spec in metrics.items():
        out[name] = metric_table(df, [], {name: spec})
    for name, kind in kinds.items():
        if kind in BUCKETS:
            out |= bucketed(df, [], name, specs[name])
    for name, kind in kinds.items():
        if kind in PIPELINES:
            out[name] = sibling(out, kind, split(specs[name])[1])
    return out


def bucketed(df: DataFrame, outer: list[str], name: str, spec: Mapping[str, Any]) -> dict[str, DataFrame]:
    kind, body, inner = split(spec)
    rows, keys = keyed(df, kind, body, name, outer)
    inner_kinds = {n: split(s)[0] for n, s in inner.items()}
    metrics = {n: inner[n] for n, k in inner_kinds.items() if k in METRICS}
    table = metric_table(rows, [*outer, *keys], metrics, count=True, of_parent=kind == "reverse_nested")
    # pipelines see the buckets that are returned, empty ones included
    table = chosen(table, outer, keys, kind, body)
    for n, k in inner_kinds.items():
        if k in PIPELINES:
            table = windowed(table, outer, keys, n, k, split(inner[n])[1])
    out = {name: table}
    for n, k in inner_kinds.items():
        if k in BUCKETS:
            kept = out[name].select(*outer, *keys) if kind in ("terms", "multi_terms", "rare_terms", "composite") else None
            below = rows if kept is None else rows.join(kept, [*outer, *keys], "left_semi")
            out |= {f"{name}>{x}": y for x, y in bucketed(below, [*outer, *keys], n, inner[n]).items()}
    return out


def keyed(df: DataFrame, kind: str, body: Mapping[str, Any], name: str, outer: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with their bucket keys; a row in several buckets is several rows."""
    col = lambda f: F.col(f)
    if kind in ("terms", "rare_terms"):
        return df.where(col(body["field"]).isNotNull()).withColumn(name, col(body["field"])), [name]
    if kind == "multi_terms":
        names = [f"{name}_{t['field']}" for t in body["terms"]]
        for n, t in zip(names, body["terms"]):
            df = df.where(col(t["field"]).isNotNull()).withColumn(n, col(t["field"]))
        return df, names
    if kind in ("range", "date_range", "ip_range"):
        value = col(body["field"])
        if kind == "ip_range":
            value = ip_key(value)
        found = []
        for r in body["ranges"]:
            ends = [e if kind != "ip_range" else ip_key(F.lit(e)) for e in (r.get("from"), r.get("to")) if e is not None]
            ends = iter(ends)
            inside = value.isNotNull()
            if r.get("from") is not None:
                low = next(ends)
                inside = inside & (value >= (F.lit(low).cast("timestamp") if kind == "date_range" else low))
            if r.get("to") is not None:
                high = next(ends)
                inside = inside & (value < (F.lit(high).cast("timestamp") if kind == "date_range" else high))
            label = r.get("key") or f"{r['from'] if r.get('from') is not None else '*'}-{r['to'] if r.get('to') is not None else '*'}"
            found.append(F.when(inside, F.lit(label)))
        return df.withColumn(name, F.explode(F.array_compact(F.array(*found)))), [name]
    if kind == "histogram":
        step, shift = body["interval"], body.get("offset", 0)
        return df.where(col(body["field"]).isNotNull()).withColumn(name, F.floor((col(body["field"]) - shift) / step) * step + shift), [name]
    if kind in ("date_histogram", "auto_date_histogram"):
        at = col(body["field"])
        if kind == "auto_date_histogram":
            # one pass for the ends; the unit is the finest that stays within the buckets
            ends = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
            span = (ends["high"] - ends["low"]).total_seconds() if ends["low"] is not None else 0
            unit = next((u for u in ("second", "minute", "hour", "day") if span / UNITS[u] <= body.get("buckets", 10)), None) or next((u for u, s in (("month", 31 * 86_400), ("quarter", 92 * 86_400)) if span / s <= body.get("buckets", 10)), "year")
            value = F.date_trunc(unit, at)
        elif "fixed_interval" in body:
            n, unit = int(body["fixed_interval"][:-1]), {"s": 1, "m": 60, "h": 3600, "d": 86_400}[body["fixed_interval"][-1]]
            value = F.timestamp_seconds(F.floor(F.unix_timestamp(at) / (n * unit)) * (n * unit))
        else:
            value = F.date_trunc(CALENDAR[body["calendar_interval"]], at)
        return df.where(at.isNotNull()).withColumn(name, value), [name]
    if kind == "variable_width_histogram":
        # approximate: the clusters of a numeric histogram, each row to the nearest centre
        centres = df.agg(F.transform(F.histogram_numeric(col(body["field"]).cast("double"), F.lit(body.get("buckets", 10))), lambda b: b["x"]).alias("_centres"))
        rows = df.where(col(body["field"]).isNotNull()).crossJoin(F.broadcast(centres))
        nearest = F.array_min(F.transform(F.col("_centres"), lambda c: F.struct(F.abs(c - col(body["field"])).alias("d"), c.alias("c"))))["c"]
        return rows.withColumn(name, nearest).drop("_centres"), [name]
    if kind == "filter":
        return df.where(body["filter"] if isinstance(body, Mapping) else body).withColumn(name, F.lit(True)), [name]
    if kind == "filters":
        return df.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in body["filters"].items()])))), [name]
    if kind == "missing":
        return df.where(col(body["field"]).isNull()).withColumn(name, F.lit(True)), [name]
    if kind == "nested":
        return df.withColumn("_parent", F.col("id")).withColumn("_nested", F.explode(body["path"])).select("*", "_nested.*").withColumn(name, F.lit(True)), [name]
    if kind == "reverse_nested":
        return df.withColumn(name, F.lit(True)), [name]
    if kind == "composite":
        names = []
        for source in body["sources"]:
            (n, s), = source.items()
            sub, b, _ = split(s)
            df, (n,) = keyed(df, sub, b, n, outer)
            names.append(n)
        return df, names
    if kind in ("sampler", "diversified_sampler"):
        order = [F.col(n).asc_nulls_last() if d == "asc" else F.col(n).desc_nulls_last() for n, d in body.get("sort", [("loggedAt", "desc"), ("id", "desc")])]
        if kind == "diversified_sampler":
            own = Window.partitionBy(*outer, body["field"]).orderBy(*order)
            df = df.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= body.get("max_docs_per_value", 1)).drop("_rank")
        if outer:
            df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*outer).orderBy(*order))).where(F.col("_rank") <= body.get("shard_size", 100)).drop("_rank")
        else:
            df = df.orderBy(*order).limit(body.get("shard_size", 100))
        return df.withColumn(name, F.lit(True)), [name]
    if kind == "adjacency_matrix":
        labels = sorted(body["filters"])
        pairs = [F.when(body["filters"][a], F.lit(a)) for a in labels] + [F.when(body["filters"][a] & body["filters"][b], F.lit(f"{a}&{b}")) for i, a in enumerate(labels) for b in labels[i + 1 :]]
        return df.withColumn(name, F.explode(F.array_compact(F.array(*pairs)))), [name]
    raise InvalidQuery(f"the aggregation {kind} is not allowed")


def ip_key(text: Column) -> Column:
    """An address as 32 hexadecimal digits, which stand in the order of addresses; null for what is none. IPv4 ones are mapped into IPv6."""
    octets = F.transform(F.split(text, "\\."), lambda x: x.cast("int"))
    four = text.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    key4 = F.when(F.forall(octets, lambda x: x <= 255), F.concat(F.lit("0" * 20 + "ffff"), F.array_join(F.transform(octets, lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")))
    halves = F.split(F.lower(text), "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
    left = groups(F.get(halves, F.lit(0)))
    right = F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    short = F.lit(8) - F.size(left) - F.size(right)
    full = F.when((F.size(halves) == 2) & (short >= 1), F.concat(left, F.array_repeat(F.lit("0"), short), right)).when((F.size(halves) == 1) & (F.size(left) == 8), left)
    key6 = F.when(text.rlike("^[0-9a-fA-F:]+$") & F.forall(full, lambda x: F.length(x) <= 4), F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(four, key4).otherwise(key6)


def metric_columns(name: str, kind: str, body: Mapping[str, Any]) -> dict[str, Column]:
    """The aggregate expressions of a metric, by column name."""
    x = F.col(body["field"]) if "field" in body and isinstance(body["field"], str) else None
    simple = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "value_count": F.count}
    if kind in simple:
        return {name: simple[kind](x)}
    if kind in ("stats", "extended_stats"):
        out = {f"{name}_count": F.count(x), f"{name}_min": F.min(x), f"{name}_max": F.max(x), f"{name}_avg": F.avg(x), f"{name}_sum": F.sum(x)}
        if kind == "extended_stats":
            sigma = body.get("sigma", 2)
            out |= {f"{name}_sum_of_squares": F.sum(x * x), f"{name}_variance": F.var_pop(x), f"{name}_std": F.stddev_pop(x), f"{name}_upper": F.avg(x) + sigma * F.stddev_pop(x), f"{name}_lower": F.avg(x) - sigma * F.stddev_pop(x)}
        return out
    if kind == "cardinality":
        return {name: F.count_distinct(x) if body.get("exact") else F.approx_count_distinct(x, body.get("rsd", 0.02))}
    if kind == "percentiles":
        percents = list(body.get("percents", DEFAULT_PERCENTS))
        at = F.array(*[F.lit(p / 100) for p in percents])
        return {name: F.percentile(x, at) if body.get("exact") else F.percentile_approx(x, [p / 100 for p in percents], body.get("accuracy", 10_000))}
    if kind == "percentile_ranks":
        return {name: F.array(*[F.avg(F.when(x <= v, 100.0).when(x.isNotNull(), 0.0)) for v in body["values"]])}
    if kind == "boxplot":
        return {f"{name}_min": F.min(x), f"{name}_max": F.max(x), f"{name}_q1": F.percentile(x, 0.25), f"{name}_q2": F.percentile(x, 0.5), f"{name}_q3": F.percentile(x, 0.75)}
    if kind == "top_metrics":
        by, direction = body["sort"]
        pick = F.max_by if direction == "desc" else F.min_by
        return {f"{name}_{m}": pick(F.col(m), F.col(by)) for m in body["metrics"]}
    if kind == "weighted_avg":
        value, weight = F.col(body["value"]), F.col(body["weight"])
        return {name: F.sum(F.when(value.isNotNull(), value * weight)) / F.sum(F.when(value.isNotNull(), weight))}
    if kind == "scripted_metric":
        return {name: body["column"]}
    if kind in ("geo_bounds", "geo_centroid"):
        lat, lon = F.col(body["lat"]), F.col(body["lon"])
        if kind == "geo_centroid":
            return {f"{name}_lat": F.avg(lat), f"{name}_lon": F.avg(lon)}
        return {f"{name}_top": F.max(lat), f"{name}_bottom": F.min(lat), f"{name}_left": F.min(lon), f"{name}_right": F.max(lon)}
    raise InvalidQuery(f"the metric {kind} is not allowed")


def metric_table(df: DataFrame, keys: list[str], metrics: Mapping[str, Any], count: bool = False, of_parent: bool = False) -> DataFrame:
    """One row per bucket: doc_count and the metrics. Those that need rows of their own are joined by the keys."""
    plain: list[Column] = [(F.count_distinct("_parent") if of_parent else F.count("*")).alias("doc_count")] if count else []
    apart = []
    for name, spec in metrics.items():
        kind, body, _ = split(spec)
        if kind in ("median_absolute_deviation", "top_hits", "string_stats"):
            apart.append((name, kind, body))
        else:
            plain += [c.alias(n) for n, c in metric_columns(name, kind, body).items()]
    table = df.groupBy(*keys).agg(*plain) if plain else None
    for name, kind, body in apart:
        own = rows_metric(df, keys, name, kind, body)
        table = own if table is None else table.join(own, keys, "left") if keys else table.crossJoin(own)
    return table


def rows_metric(df: DataFrame, keys: list[str], name: str, kind: str, body: Mapping[str, Any]) -> DataFrame:
    if kind == "median_absolute_deviation":
        x = F.col(body["field"])
        own = Window.partitionBy(*keys) if keys else None
        if own is None:
            middle = df.agg(F.percentile(x, 0.5).alias("_m"))
            return df.crossJoin(F.broadcast(middle)).agg(F.percentile(F.abs(x - F.col("_m")), 0.5).alias(name))
        middle = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("_m"))
        return df.join(middle, keys).groupBy(*keys).agg(F.percentile(F.abs(x - F.col("_m")), 0.5).alias(name))
    if kind == "top_hits":
        order = [F.col(n).asc_nulls_last() if d == "asc" else F.col(n).desc_nulls_last() for n, d in body.get("sort", [("loggedAt", "desc"), ("id", "desc")])]
        fields = body.get("_source", ["id"])
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order))).where(F.col("_rank") <= body.get("size", 3))
        hits = F.transform(F.array_sort(F.collect_list(F.struct("_rank", *fields))), lambda h: F.struct(*[h[f].alias(f) for f in fields]))
        return ranked.groupBy(*keys).agg(hits.alias(name))
    # string_stats: characters are counted per bucket before entropy is taken of their shares
    x = F.col(body["field"])
    stats = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias(f"{name}_count"), F.min(F.length(x)).alias(f"{name}_min_length"), F.max(F.length(x)).alias(f"{name}_max_length"), F.avg(F.length(x)).alias(f"{name}_avg_length"), F.sum(F.length(x)).alias("_all"))
    chars = df.where(x.isNotNull()).select(*keys, F.explode(F.filter(F.split(x, ""), lambda c: c != "")).alias("_c")).groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    joined = chars.join(stats, keys) if keys else chars.crossJoin(F.broadcast(stats))
    share = F.col("_n") / F.col("_all")
    entropy = joined.groupBy(*keys).agg((-F.sum(share * F.log2(share))).alias(f"{name}_entropy"))
    stats = stats.drop("_all")
    return stats.join(entropy, keys, "left") if keys else stats.crossJoin(entropy)


def chosen(table: DataFrame, outer: list[str], keys: list[str], kind: str, body: Mapping[str, Any]) -> DataFrame:
    """Which buckets are returned: top terms, rare ones, a composite page, filled gaps."""
    if kind in ("terms", "multi_terms"):
        table = table.where(F.col("doc_count") >= body.get("min_doc_count", 1))
        order = [F.col(n).asc() if d == "asc" else F.col(n).desc() for n, d in body["order"]] if body.get("order") else [F.col("doc_count").desc()]
        order += [F.col(k).asc() for k in keys]
        size = body.get("size", 10)
        if not outer:
            return table.orderBy(*order).limit(size)
        return table.withColumn("_rank", F.row_number().over(Window.partitionBy(*outer).orderBy(*order))).where(F.col("_rank") <= size).drop("_rank")
    if kind == "rare_terms":
        return table.where(F.col("doc_count") <= body.get("max_doc_count", 1)).orderBy("doc_count", *keys)
    if kind == "composite":
        if body.get("after"):
            out = F.lit(False)
            for k in reversed(keys):
                v = F.lit(body["after"][k])
                out = (F.col(k) > v) | ((F.col(k) == v) & out)
            table = table.where(out)
        return table.orderBy(*keys).limit(body.get("size", 10))
    if kind in ("histogram", "date_histogram") and body.get("min_doc_count", 0) == 0:
        return filled(table, outer, keys[0], kind, body)
    if kind in ("histogram", "date_histogram"):
        return table.where(F.col("doc_count") >= body["min_doc_count"])
    return table


def filled(table: DataFrame, outer: list[str], key: str, kind: str, body: Mapping[str, Any]) -> DataFrame:
    """Adds empty buckets between the first and the last of each outer bucket."""
    if kind == "histogram":
        step = body["interval"]
        steps = F.transform(F.sequence(F.lit(0).cast("long"), F.round((F.col("_high") - F.col("_low")) / step).cast("long")), lambda i: F.col("_low") + i * step)
    elif "fixed_interval" in body:
        n, unit = int(body["fixed_interval"][:-1]), {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY"}[body["fixed_interval"][-1]]
        steps = F.sequence("_low", "_high", F.expr(f"INTERVAL {n} {unit}"))
    else:
        unit = {"quarter": "3 MONTH", "week": "7 DAY"}.get(body["calendar_interval"], f"1 {body['calendar_interval'].upper()}")
        n, unit = unit.split()
        steps = F.sequence("_low", "_high", F.expr(f"INTERVAL {n} {unit}"))
    spine = table.groupBy(*outer).agg(F.min(key).alias("_low"), F.max(key).alias("_high")).where("_low IS NOT NULL").select(*outer, F.explode(steps).alias(key)).withColumn(key, F.col(key).cast(table.schema[key].dataType))
    return spine.join(table, [*outer, key], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def windowed(table: DataFrame, outer: list[str], keys: list[str], name: str, kind: str, body: Mapping[str, Any]) -> DataFrame:
    """Pipelines inside their parent: a column over the buckets in order, or which buckets stay."""
    own = Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(1))
    order = own.orderBy(*keys)
    path = body.get("buckets_path", "doc_count")
    x = F.col("doc_count" if path == "_count" else path) if isinstance(path, str) else None
    if kind == "cumulative_sum":
        return table.withColumn(name, F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if kind == "derivative":
        return table.withColumn(name, x - F.lag(x).over(order))
    if kind == "serial_diff":
        return table.withColumn(name, x - F.lag(x, body.get("lag", 1)).over(order))
    if kind == "moving_fn":
        fn = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop}[body.get("fn", "avg")]
        return table.withColumn(name, fn(x).over(order.rowsBetween(-body["window"], -1)))
    if kind == "moving_percentiles":
        return table.withColumn(name, F.percentile_approx(x, [p / 100 for p in body.get("percents", DEFAULT_PERCENTS)]).over(order.rowsBetween(-body["window"], -1)))
    if kind == "bucket_script":
        return table.withColumn(name, body["script"] if isinstance(body["script"], Column) else F.expr(body["script"]))
    if kind == "bucket_selector":
        return table.where(body["script"])
    if kind == "bucket_sort":
        by = [F.col(n).asc_nulls_last() if d == "asc" else F.col(n).desc_nulls_last() for n, d in body.get("sort", [])] + [F.col(k) for k in keys]
        low = body.get("from", 0)
        table = table.withColumn("_rank", F.row_number().over(own.orderBy(*by))).where(F.col("_rank") > low)
        return (table.where(F.col("_rank") <= low + body["size"]) if "size" in body else table).drop("_rank")
    if kind == "normalize":
        whole = own
        low, high, total, mean, std = (f(x).over(whole) for f in (F.min, F.max, F.sum, F.avg, F.stddev_pop))
        value = {"rescale_0_1": (x - low) / (high - low), "rescale_0_100": 100 * (x - low) / (high - low), "percent_of_sum": x / total, "mean": (x - mean) / (high - low), "z-score": (x - mean) / std}[body["method"]]
        return table.withColumn(name, value)
    if kind == "bucket_count_ks_test":
        # two samples over the same ordered buckets: doc_count against a column of expected counts, uniform if none is named
        expected = F.col(body["expected"]) if body.get("expected") else F.lit(1.0)
        run = order.rowsBetween(Window.unboundedPreceding, 0)
        apart = F.sum(x).over(run) / F.sum(x).over(own) - F.sum(expected).over(run) / F.sum(expected).over(own)
        return table.withColumn("_apart", apart).withColumn(f"{name}_less", F.max(-F.col("_apart")).over(own)).withColumn(f"{name}_greater", F.max("_apart").over(own)).withColumn(f"{name}_two_sided", F.max(F.abs("_apart")).over(own)).drop("_apart")
    raise InvalidQuery(f"{kind} does not belong inside a bucket aggregation")


def sibling(tables: Mapping[str, DataFrame], kind: str, body: Mapping[str, Any]) -> DataFrame:
    """Pipelines beside a bucket aggregation: one value over all its buckets."""
    path, _, column = body["buckets_path"].rpartition(">")
    table, x = tables[path], F.col("doc_count" if column == "_count" else column)
    one = {"avg_bucket": F.avg, "min_bucket": F.min, "max_bucket": F.max, "sum_bucket": F.sum}
    if kind in one:
        return table.agg(one[kind](x).alias("value"))
    if kind in ("stats_bucket", "extended_stats_bucket"):
        table = table.withColumn("value", x)
        return table.agg(*[c.alias(n.removeprefix("v_")) for n, c in metric_columns("v", kind.removesuffix("_bucket"), {"field": "value"}).items()])
    if kind == "percentiles_bucket":
        return table.agg(F.percentile(x, F.array(*[F.lit(p / 100) for p in body.get("percents", DEFAULT_PERCENTS)])).alias("value"))
    raise InvalidQuery(f"{kind} belongs inside a bucket aggregation")
