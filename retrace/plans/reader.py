"""Reading: a query over a table of records becomes a page, an export, or a set of aggregations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from retrace.errors import InvalidQuery, SnapshotExpired
from retrace.model import RESERVED
from retrace.operators.aggs import aggregate, check_aggregations
from retrace.plans.query import Cursor, HistoryQuery

ORDER = ("loggedAt", "id", "_index")
#: Keys of a raw body, and those of them that only a scoring store could honour.
BODY = {"query", "aggs", "aggregations", "size", "from", "sort", "search_after", "_source", "fields", "docvalue_fields", "stored_fields", "track_total_hits", "post_filter", "collapse", "timeout", "version", "seq_no_primary_term", "min_score"}
SCORED = {"highlight", "explain"}
Extension = Callable[[HistoryQuery], HistoryQuery]
Decorator = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    max_limit: int = 1000
    max_result_window: int = 10_000
    snapshot_seconds: float = 60.0


@dataclass(frozen=True)
class Page:
    """One page: its rows lazily, the exact total only if it is asked for."""

    rows: DataFrame
    matching: DataFrame
    query: HistoryQuery
    limits: Limits
    kinds: Mapping[str, str]

    @cached_property
    def hits(self) -> list[Row]:
        """The rows as fetched, at most the limit, before any decorator."""
        return self.rows.collect()

    @cached_property
    def total(self) -> int:
        return 0 if self.query.nothing else self.matching.count()

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.query.limit)

    @property
    def max_reachable_page(self) -> int:
        return min(self.total_pages, self.limits.max_result_window // self.query.limit)

    @property
    def has_more(self) -> bool:
        if self.query.cursor is not None:
            return len(self.hits) == self.query.limit
        return (self.query.number or 1) < self.total_pages

    @property
    def next_token(self) -> str | None:
        """The token of the next page, if there may be one and the last row has a place in the order."""
        if len(self.hits) < self.query.limit or not self.hits:
            return None
        last = self.hits[-1]
        if last["loggedAt"] is None or last["id"] is None:
            return None
        return Cursor((last["loggedAt"].isoformat(sep=" "), last["id"], last["_index"]), self.query.fingerprint()).token()


def ordered(newest_first: bool) -> list[Column]:
    """The total order: all parts in one direction, rows without a value last in both."""
    return [F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_last() for c in ORDER]


def after(cursor: Cursor, newest_first: bool) -> Column:
    """Strict successors of a place: a comparison of the whole tuple, with missing values last."""
    if len(cursor.sort) != len(ORDER):
        raise InvalidQuery("the token has another order")
    out = F.lit(False)
    values = [F.lit(cursor.sort[0]).cast("timestamp"), F.lit(cursor.sort[1]), F.lit(cursor.sort[2])]
    for name, value in reversed(list(zip(ORDER, values))):
        col = F.col(name)
        beyond = (col < value) if newest_first else (col > value)
        out = col.isNull() | beyond | ((col == value) & out)
    return out


class Reader:
    """Answers queries over the tables of a store.

    ``tables`` maps a table's name to its DataFrame of records, ``routing`` an object type to a name. Extensions
    rewrite every query before it is compiled (visibility, tenants) and may only narrow it; decorators see the rows of one page.
    """

    def __init__(self, tables: Mapping[str, DataFrame], routing: Mapping[str, str] | None = None, default: str = "audit_log", extensions: Sequence[Extension] = (), decorators: Sequence[Decorator] = (), limits: Limits | None = None):
        self.tables, self.routing, self.default = dict(tables), dict(routing or {}), default
        self.extensions, self.decorators, self.limits = list(extensions), list(decorators), limits or Limits()

    def scan(self, query: HistoryQuery) -> DataFrame:
        """One table for one type; all routed ones, each once, for any()."""
        if query.object_type is not None:
            names = [self.routing.get(query.object_type, self.default)]
        else:
            names = list(dict.fromkeys([self.default, *self.routing.values()]))
        parts = [self.tables[n].withColumn("_index", F.lit(n)) for n in names if n in self.tables]
        if not parts:
            raise InvalidQuery(f"there is no table {names[0]}")
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def extended(self, query: HistoryQuery) -> HistoryQuery:
        """The query after all extensions. A cursor has to fit what they make of it."""
        out = replace(query, cursor=None)
        for extension in self.extensions:
            out = replace(extension(out), cursor=None)
        if query.cursor is not None:
            if query.cursor.query != out.fingerprint():
                raise InvalidQuery("the token belongs to another search")
            out = replace(out, cursor=query.cursor, number=None)
        return out

    def matching(self, query: HistoryQuery, scan: DataFrame | None = None) -> DataFrame:
        scan = self.scan(query) if scan is None else scan
        return scan.where(query.predicate(dict(scan.dtypes)))

    def find(self, query: HistoryQuery) -> Page:
        query = self.extended(query)
        self._check(query)
        matching = self.matching(query)
        rows = matching.where(after(query.cursor, query.newest_first)) if query.cursor is not None else matching
        rows = rows.orderBy(*ordered(query.newest_first))
        if query.cursor is None and query.number and query.number > 1:
            rows = rows.offset((query.number - 1) * query.limit)
        return Page(rows.limit(query.limit), matching, query, self.limits, dict(matching.dtypes))

    def decorated(self, page: Page) -> DataFrame:
        """The rows of a page after the decorators; its token and total are those of the rows fetched."""
        rows = page.rows
        for decorate in self.decorators:
            rows = decorate(rows)
        return rows

    def iterate(self, query: HistoryQuery, batch: int = 500) -> Iterator[Row]:
        """All rows in order, from one snapshot: the plan is fixed now, and files added later are not read.

        Rows arrive partition by partition of one sort; nothing is counted and nothing held but a batch.
        """
        if query.number is not None or query.cursor is not None:
            raise InvalidQuery("an export has no page")
        query = self.extended(query)
        if batch < 1 or batch > self.limits.max_limit:
            raise InvalidQuery("a batch is between 1 and the largest limit")
        if query.nothing:
            return
        rows = self.matching(query).orderBy(*ordered(query.newest_first))
        until = time.monotonic() + self.limits.snapshot_seconds
        for i, row in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
            if i % batch == 0:
                if time.monotonic() > until:
                    raise SnapshotExpired(f"more than {self.limits.snapshot_seconds} s between two batches")
                until = time.monotonic() + self.limits.snapshot_seconds
            yield row

    def raw(self, query: HistoryQuery, body: Mapping[str, Any]) -> dict[str, Any]:
        """Aggregations and hits of a body, inside the query's boundary and never outside it.

        ``query`` and ``post_filter`` of the body are Columns; both are ANDed to the boundary, the latter for hits only.
        Returns hits (a DataFrame), total (a DataFrame of one row, unless switched off) and aggregations (DataFrames by name).
        """
        self._check_body(body)
        query = self.extended(query)
        boundary = self.matching(query)
        if body.get("query") is not None:
            boundary = boundary.where(body["query"])
        out: dict[str, Any] = {"hits": self._hits(boundary, query, body)}
        if body.get("track_total_hits", True):
            out["total"] = boundary.agg(F.count("*").alias("total"))
        specs = body.get("aggs", body.get("aggregations"))
        if specs and not query.nothing:
            out["aggregations"] = aggregate(boundary, specs)
        return out

    def _hits(self, rows: DataFrame, query: HistoryQuery, body: Mapping[str, Any]) -> DataFrame:
        if body.get("post_filter") is not None:
            rows = rows.where(body["post_filter"])
        order = [F.col(n).asc_nulls_last() if d == "asc" else F.col(n).desc_nulls_last() for n, d in body["sort"]] if body.get("sort") else ordered(query.newest_first)
        if body.get("collapse"):
            from pyspark.sql import Window

            best = Window.partitionBy(body["collapse"]["field"]).orderBy(*order)
            rows = rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
        if body.get("search_after"):
            rows = rows.where(after_values(body["sort"], body["search_after"]) if body.get("sort") else after(Cursor(tuple(body["search_after"]), ""), query.newest_first))
        rows = rows.orderBy(*order)
        if body.get("from"):
            rows = rows.offset(body["from"])
        rows = rows.limit(body.get("size", 10))
        wanted = next((body[k] for k in ("_source", "fields", "docvalue_fields", "stored_fields") if isinstance(body.get(k), list | tuple)), None)
        return rows.select(*wanted) if wanted else rows

    def _check(self, query: HistoryQuery) -> None:
        if query.limit > self.limits.max_limit:
            raise InvalidQuery(f"the limit is above {self.limits.max_limit}")
        if query.cursor is None and (query.number or 1) * query.limit > self.limits.max_result_window:
            raise InvalidQuery(f"the page is beyond the first {self.limits.max_result_window} rows; continue with a token")

    def _check_body(self, body: Mapping[str, Any]) -> None:
        if unknown := set(body) - BODY:
            raise InvalidQuery(f"{sorted(unknown)[0]} is not allowed in a raw body" + (": nothing is scored here" if unknown & SCORED else ""))
        size, start = body.get("size", 10), body.get("from", 0)
        if body.get("search_after") and body.get("from"):
            raise InvalidQuery("from and search_after exclude each other")
        if not 0 <= size <= self.limits.max_limit or start < 0:
            raise InvalidQuery(f"the size is above {self.limits.max_limit}")
        if not body.get("search_after") and start + size > self.limits.max_result_window:
            raise InvalidQuery("the page is beyond the result window")
        for key in ("aggs", "aggregations"):
            if key in body:
                check_aggregations(body[key])


def after_values(sort: Sequence[tuple[str, str]], values: Sequence[Any]) -> Column:
    """Rows that stand after the given values of the sort fields, in the order of the sort: missing values come last either way."""
    if len(values) != len(sort):
        raise InvalidQuery("search_after has a value for each field of the sort")
    out, equal = F.lit(False), F.lit(True)
    for (name, direction), value in zip(sort, values):
        column = F.col(name)
        beyond = F.lit(False) if value is None else column.isNull() | (column > F.lit(value) if direction == "asc" else column < F.lit(value))
        out = out | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    return out


def hydrate(rows: DataFrame, declared: Sequence[str] = ()) -> DataFrame:
    """Stored rows of any age as entries: missing or unreadable values become defaults, each with a warning.

    Takes JSON documents read with every base field as text. Documents before ids have the store's name of
    the row as id; an unreadable time becomes the epoch; ``extra`` has what is no base field nor declared.
    """
    have = set(rows.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    at = F.coalesce(F.try_to_timestamp(text("loggedAt"), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text("loggedAt")))
    identity = F.coalesce(text("id"), text("_id"))
    warnings = F.array_compact(F.array(
        F.when(at.isNull(), F.lit("loggedAt")), F.when(text("objectType").isNull(), F.lit("objectType")), F.when(text("objectId").isNull(), F.lit("objectId")), F.when(text("event").isNull(), F.lit("event"))))
    others = [c for c in rows.columns if c not in RESERVED and c not in ("_id", "_index", "writtenAt") and c not in declared]
    extra = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit("{}")
    changes = F.col("changes") if "changes" in have else F.lit(None)
    return rows.select(
        identity.alias("id"), F.coalesce(text("objectType"), F.lit("")).alias("objectType"), F.coalesce(text("objectId"), F.lit("")).alias("objectId"), F.coalesce(text("event"), F.lit("")).alias("event"),
        F.coalesce(at, F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("loggedAt"), text("source").alias("source"), changes.alias("changes"), *[F.col(c) for c in declared if c in have], extra.alias("extra"), warnings.alias("warnings"))
