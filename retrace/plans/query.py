"""A history query: an immutable description that can only be narrowed by what comes after it."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from retrace.errors import InvalidQuery
from retrace.model import RESERVED

MOST_TERMS, MOST_TOKEN, MOST_DEPTH, CURSOR_VERSION = 65_536, 4096, 8, 2
Scalar = str | int | float | bool


def _list(values: Iterable[Any], what: str) -> tuple:
    out = tuple(dict.fromkeys((type(v).__name__ == "bool", v) for v in values))
    if not out:
        raise InvalidQuery(f"an empty list of {what} would ask for everything or nothing")
    if len(out) > MOST_TERMS:
        raise InvalidQuery(f"more than {MOST_TERMS} {what}")
    return tuple(v for _, v in out)


def _alike(a: Any, b: Any) -> bool:
    """1 and "1" are one value to the store; a bool is no number."""
    return isinstance(a, bool) == isinstance(b, bool) and (a == b or str(a) == str(b))


def _second(at: datetime | None) -> datetime | None:
    if at is None:
        return None
    return (at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at).replace(microsecond=0)


@dataclass(frozen=True)
class Filter:
    """One attribute's condition: is, in, exists, missing or between (inclusive, one end may be open)."""

    field: str
    kind: str
    values: tuple = ()
    low: Any = None
    high: Any = None

    def __post_init__(self) -> None:
        if not self.field:
            raise InvalidQuery("a filter needs a field")
        if self.field in RESERVED:
            raise InvalidQuery(f"{self.field} has a method of its own")
        if self.kind == "between":
            if self.low is None and self.high is None:
                raise InvalidQuery("a range needs an end")
            comparable = all(isinstance(x, int | float) and not isinstance(x, bool) for x in (self.low, self.high)) or all(isinstance(x, datetime) for x in (self.low, self.high))
            if comparable and self.low > self.high:
                raise InvalidQuery("a range must not be crossed")
        for v in self.values:
            if not isinstance(v, str | int | float | bool):
                raise InvalidQuery("an attribute is compared with scalars only")

    def column(self, kinds: dict[str, str]) -> Column:
        col = F.col(f"`{self.field}`")
        array = kinds.get(self.field, "").startswith("array")
        if self.kind == "is":
            return F.array_contains(col, self.values[0]) if array else col == F.lit(self.values[0])
        if self.kind == "in":
            return F.arrays_overlap(col, F.array(*map(F.lit, self.values))) if array else col.isin(*self.values)
        if self.kind in ("exists", "missing"):
            has = col.isNotNull() & (F.size(col) > 0) if array else col.isNotNull()
            return has if self.kind == "exists" else ~has
        ends = [op for x, op in ((self.low, lambda x: col >= F.lit(x)), (self.high, lambda x: col <= F.lit(x))) if x is not None for op in [op(x)]]
        return ends[0] if len(ends) == 1 else ends[0] & ends[1]


@dataclass(frozen=True)
class Cursor:
    """A place in an order: the sort values of the last row, and the fingerprint of the search they belong to."""

    sort: tuple
    query: str

    def token(self) -> str:
        if any(v is None for v in self.sort):
            raise InvalidQuery("a row without a value in the order can't be continued after")
        text = json.dumps({"v": CURSOR_VERSION, "s": list(self.sort), "q": self.query}, separators=(",", ":"))
        out = base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
        if len(out) > MOST_TOKEN:
            raise InvalidQuery("the token would be too long")
        return out

    @classmethod
    def of(cls, token: str) -> Cursor:
        if not token or len(token) > MOST_TOKEN:
            raise InvalidQuery("no token")
        try:
            data = json.loads(base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True))
        except (ValueError, binascii.Error) as e:
            raise InvalidQuery("the token can't be read") from e
        if not isinstance(data, dict) or data.get("v") != CURSOR_VERSION:
            raise InvalidQuery("the token is of another version")
        sort, query = data.get("s"), data.get("q")
        if not isinstance(sort, list) or not sort or not isinstance(query, str) or any(not isinstance(x, str | int | float) or isinstance(x, bool) for x in sort):
            raise InvalidQuery("the token has no place")
        return cls(tuple(sort), query)


@dataclass(frozen=True)
class HistoryQuery:
    """What to ask. ``with_*`` and ``where*`` replace what they set before, ``narrow*`` intersect with it."""

    object_type: str | None
    object_ids: tuple | None = None
    events: tuple | None = None
    actors: tuple | None = None
    ids: tuple | None = None
    since: datetime | None = None
    until: datetime | None = None
    filters: tuple[Filter, ...] = ()
    options: tuple[tuple[str, str], ...] = ()
    newest_first: bool = True
    number: int | None = None
    limit: int = 50
    cursor: Cursor | None = None
    nothing: bool = field(default=False)

    @classmethod
    def for_(cls, object_type: str) -> HistoryQuery:
        if not object_type:
            raise InvalidQuery("an object type is needed; any() asks for all")
        return cls(object_type)

    @classmethod
    def any(cls) -> HistoryQuery:
        return cls(None)

    def _new(self, **changes: Any) -> HistoryQuery:
        """Another search: a cursor of the old one no longer fits."""
        return replace(self, cursor=None, **changes)

    def with_object_ids(self, *ids: str | int) -> HistoryQuery:
        return self._new(object_ids=_list(ids, "object ids"))

    def with_events(self, *events: str) -> HistoryQuery:
        return self._new(events=_list(events, "events"))

    def with_actors(self, *actors: str) -> HistoryQuery:
        return self._new(actors=_list(actors, "actors"))

    def with_ids(self, *ids: str) -> HistoryQuery:
        return self._new(ids=_list(ids, "ids"))

    def between(self, since: datetime | None, until: datetime | None) -> HistoryQuery:
        since, until = _second(since), _second(until)
        if since is not None and until is not None and since > until:
            raise InvalidQuery("a range must not be crossed")
        return self._new(since=since, until=until)

    def _filter(self, new: Filter) -> HistoryQuery:
        return self._new(filters=(*(f for f in self.filters if f.field != new.field), new))

    def where(self, name: str, value: Scalar) -> HistoryQuery:
        return self._filter(Filter(name, "is", (value,)))

    def where_in(self, name: str, *values: Scalar) -> HistoryQuery:
        return self._filter(Filter(name, "in", _list(values, name)))

    def where_exists(self, name: str) -> HistoryQuery:
        return self._filter(Filter(name, "exists"))

    def where_not_exists(self, name: str) -> HistoryQuery:
        return self._filter(Filter(name, "missing"))

    def where_between(self, name: str, low: Any, high: Any) -> HistoryQuery:
        return self._filter(Filter(name, "between", (), low, high))

    def _narrow(self, name: str, values: Iterable[Any]) -> HistoryQuery:
        values, now = tuple(values), getattr(self, name)
        left = tuple(v for v in (values if now is None else now) if any(v == w and type(v) is type(w) for w in values))
        return self._new(**{name: _list(left, name)}) if left else self.match_nothing()

    def narrow_object_ids(self, *ids: str | int) -> HistoryQuery:
        return self._narrow("object_ids", ids)

    def narrow_actors(self, *actors: str) -> HistoryQuery:
        return self._narrow("actors", actors)

    def narrow_in(self, name: str, *values: Scalar) -> HistoryQuery:
        """Adds a list to what a field's condition allows already; the answer can only get smaller."""
        if not values:
            return self.match_nothing()
        now = next((f for f in self.filters if f.field == name), None)
        if now is None or now.kind == "exists":
            return self.where_in(name, *values)
        if now.kind == "missing":
            return self.match_nothing()
        if now.kind == "between":
            raise InvalidQuery("a range can't be narrowed by a list")
        left = [v for v in now.values if any(_alike(v, w) for w in values)]
        if not left:
            return self.match_nothing()
        return self if now.kind == "is" else self.where_in(name, *left)

    def match_nothing(self) -> HistoryQuery:
        return self._new(nothing=True)

    def with_option(self, name: str, value: Any) -> HistoryQuery:
        """A parameter of the application; it is part of the search's fingerprint."""

        def check(x: Any, depth: int) -> None:
            if depth > MOST_DEPTH or not (x is None or isinstance(x, str | int | float | bool | list | tuple | dict)):
                raise InvalidQuery("an option is made of scalars and lists")
            for y in x.values() if isinstance(x, dict) else x if isinstance(x, list | tuple) else ():
                check(y, depth + 1)

        check(value, 1)
        return self._new(options=tuple(sorted({**dict(self.options), name: json.dumps(value, sort_keys=True)}.items())))

    def option(self, name: str, default: Any = None) -> Any:
        found = dict(self.options).get(name)
        return default if found is None else json.loads(found)

    def oldest_first(self) -> HistoryQuery:
        return self._new(newest_first=False)

    def latest_first(self) -> HistoryQuery:
        return self._new(newest_first=True)

    def page(self, number: int, limit: int) -> HistoryQuery:
        if number < 1 or limit < 1:
            raise InvalidQuery("pages and limits count from 1")
        return self._new(number=number, limit=limit)

    def take(self, limit: int) -> HistoryQuery:
        """Another size of the page; a cursor still fits."""
        if limit < 1:
            raise InvalidQuery("limits count from 1")
        return replace(self, limit=limit)

    def after(self, token: str) -> HistoryQuery:
        """Continues after a token. Whose search it belongs to is judged by the reader, on what its extensions make of this query."""
        return replace(self, cursor=Cursor.of(token), number=None)

    def fingerprint(self) -> str:
        """Names the search: all but page, limit and cursor."""
        parts = [self.object_type, self.object_ids, self.events, self.actors, self.ids, str(self.since), str(self.until), [[f.field, f.kind, [repr(v) for v in f.values], repr(f.low), repr(f.high)] for f in sorted(self.filters, key=lambda f: f.field)], self.options, self.newest_first, self.nothing]
        return hashlib.blake2b(json.dumps(parts, default=repr).encode(), digest_size=16).hexdigest()

    def predicate(self, kinds: dict[str, str] | None = None) -> Column:
        """One conjunction for the scan; a query that matches nothing becomes an empty relation."""
        if self.nothing:
            return F.lit(False)
        kinds, all_ = kinds or {}, []
        if self.object_type is not None:
            all_.append(F.col("objectType") == self.object_type)
        for name, values in (("objectId", self.object_ids), ("event", self.events), ("source", self.actors), ("id", self.ids)):
            if values is not None:
                plain = [str(v) for v in values] if kinds.get(name, "string") == "string" else list(values)
                all_.append(F.col(name) == plain[0] if len(plain) == 1 else F.col(name).isin(*plain))
        if self.since is not None:
            all_.append(F.col("loggedAt") >= F.lit(self.since))
        if self.until is not None:
            all_.append(F.col("loggedAt") < F.lit(self.until) + F.expr("INTERVAL 1 SECOND"))
        all_ += [f.column(kinds) for f in self.filters]
        return reduce(and_, all_) if all_ else F.lit(True)
