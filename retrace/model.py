"""The change record: fields, schema, canonical values, and the pair rule."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import types as T

CREATE, UPDATE, REMOVE = "create", "update", "remove"
#: Fields of the stored form; an attribute may have none of these names, nor WRITTEN_AT.
RESERVED = ("id", "objectType", "objectId", "event", "loggedAt", "source", "changes")
WRITTEN_AT = "writtenAt"

CHANGE = T.StructType([T.StructField("pair", T.BooleanType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType()), T.StructField("raw", T.StringType())])
RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("objectType", T.StringType()), T.StructField("objectId", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("loggedAt", T.TimestampType()), T.StructField("writtenAt", T.TimestampType()), T.StructField("source", T.StringType()),
    T.StructField("changes", T.MapType(T.StringType(), CHANGE)), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])


def instant_text(at: datetime) -> str:
    """UTC, to the second; microseconds only where there are any."""
    at = at.astimezone(UTC) if at.tzinfo else at
    return at.strftime("%Y-%m-%d %H:%M:%S.%f" if at.microsecond else "%Y-%m-%d %H:%M:%S")


def canonical(value: Any) -> str:
    """JSON text by which values are compared: keys sorted, 1 and 1.0 and "1" apart, instants as text."""

    def plain(x: Any) -> Any:
        if isinstance(x, datetime):
            return instant_text(x)
        if isinstance(x, date):
            return x.isoformat()
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple | set):
            return [plain(v) for v in x]
        if isinstance(x, bytes | bytearray | memoryview):
            raise TypeError("binary values are not kept in a history")
        return x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def is_pair(change: Any) -> bool:
    """Whether a change is old and new: a map with both keys, whatever their values."""
    return isinstance(change, dict) and "old" in change and "new" in change


def change_struct(change: Any) -> dict[str, Any]:
    """A change as a value of CHANGE; what is no pair is content in its own right."""
    if is_pair(change):
        return {"pair": True, "old": canonical(change["old"]), "new": canonical(change["new"]), "raw": None}
    return {"pair": False, "old": None, "new": None, "raw": canonical(change)}
