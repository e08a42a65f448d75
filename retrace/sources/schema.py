"""Tables of records: their declared schema, adding to it, and checking what is there against it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

from retrace.errors import InvalidDeclaration
from retrace.functions.values import index_name
from retrace.model import CHANGE, RESERVED, WRITTEN_AT
from retrace.operators.write import Enricher

ID_TYPES = {"keyword": T.StringType(), "integer": T.IntegerType(), "long": T.LongType()}


@dataclass(frozen=True)
class TableDefinition:
    """A table: base fields, declared attributes by SQL type, and what may be searched.

    The schema is closed for search and open for storage: attributes nobody declared are kept in ``attributes`` and
    are no columns; changes are stored and no query may filter on them.
    """

    name: str
    declared: Mapping[str, str] = field(default_factory=dict)
    object_id_type: str = "keyword"

    def __post_init__(self) -> None:
        index_name(self.name)
        if self.object_id_type not in ID_TYPES:
            raise InvalidDeclaration(f"an object id is one of {', '.join(ID_TYPES)}")
        if bad := [n for n in self.declared if n in RESERVED or n in (WRITTEN_AT, "attributes")]:
            raise InvalidDeclaration(f"{bad[0]} is a base field")

    def schema(self) -> T.StructType:
        base = [("id", T.StringType()), ("objectType", T.StringType()), ("objectId", ID_TYPES[self.object_id_type]), ("event", T.StringType()), ("loggedAt", T.TimestampType()), (WRITTEN_AT, T.TimestampType()), ("source", T.StringType()), ("changes", T.MapType(T.StringType(), CHANGE)), ("attributes", T.MapType(T.StringType(), T.StringType()))]
        own = [(n, T._parse_datatype_string(t)) for n, t in self.declared.items()]
        return T.StructType([T.StructField(n, t) for n, t in [*base, *own]])

    def dump(self) -> str:
        """The schema as JSON, for a golden file."""
        return json.dumps(json.loads(self.schema().json()), indent=2, sort_keys=True)


def declared_of(enrichers: Iterable[Enricher], types: Mapping[str, str], routed_types: Iterable[str] = ()) -> dict[str, str]:
    """The attributes a table has to declare: those of the enrichers whose types are routed to it."""
    routed = set(routed_types)
    return {n: types.get(n, "string") for e in enrichers if not e.types or not routed or routed & set(e.types) for n in e.attributes}


def paths(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Every field by its dotted path, with its type; structs by their fields."""
    out: dict[str, str] = {}
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out |= paths(f.dataType, name + ".")
        else:
            out[name] = f.dataType.simpleString()
    return out


@dataclass(frozen=True)
class Difference:
    missing: dict[str, str]
    mismatched: dict[str, tuple[str, str]]
    unexpected: dict[str, str]

    @property
    def clean(self) -> bool:
        return not (self.missing or self.mismatched)


def compare(expected: T.StructType, found: T.StructType) -> Difference:
    """What a table lacks and what it has otherwise, by path."""
    a, b = paths(expected), paths(found)
    return Difference({k: v for k, v in a.items() if k not in b}, {k: (v, b[k]) for k, v in a.items() if k in b and b[k] != v}, {k: v for k, v in b.items() if k not in a})


def added(expected: T.StructType, found: T.StructType) -> T.StructType:
    """The found schema with the missing fields added, at any depth; a changed type is refused, never rewritten."""
    if changed := compare(expected, found).mismatched:
        raise InvalidDeclaration(f"{next(iter(changed))} has another type in the table")

    def merge(a: T.StructType, b: T.StructType) -> T.StructType:
        fields = {f.name: f for f in b.fields}
        for f in a.fields:
            if f.name not in fields:
                fields[f.name] = T.StructField(f.name, f.dataType, True)
            elif isinstance(f.dataType, T.StructType) and isinstance(fields[f.name].dataType, T.StructType):
                fields[f.name] = T.StructField(f.name, merge(f.dataType, fields[f.name].dataType), True)
        return T.StructType(list(fields.values()))

    return merge(expected, found)
