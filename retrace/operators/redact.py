"""Redaction: masks changes and removes attributes by rule, before anything is written."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrace.errors import InvalidDeclaration
from retrace.functions.values import last_segment

EMPTY = ("null", '""', "[]", "{}")


@dataclass(frozen=True)
class Rules:
    """Fields to redact: a name, or type.name for one object type. A dot is a type's scope, never a path."""

    fields: tuple[str, ...]
    placeholder: str = "***"
    max_depth: int = 16
    max_nodes: int = 10_000

    def __post_init__(self) -> None:
        if any(not f or f.count(".") > 1 for f in self.fields):
            raise InvalidDeclaration("a rule is a field, or a type and a field")

    def names(self, object_type: str) -> set[str]:
        return {f for f in self.fields if "." not in f} | {f.partition(".")[2] for f in self.fields if f.startswith(object_type + ".")}


def hit(rules: Rules, object_type: Column, field: Column) -> Column:
    """Whether a rule covers a field: exactly, as the start of a dotted name, or as its last segment."""
    out = F.lit(False)
    for rule in rules.fields:
        scope, _, name = rule.rpartition(".")
        one = (field == name) | field.startswith(name + ".") | (last_segment(field) == name)
        out = out | (one & (object_type == scope) if scope else one)
    return out


def mask(rules: Rules, value: Column) -> Column:
    """The placeholder as JSON text; null, empty text and empty lists say nothing and stay."""
    return F.when(value.isNull() | value.isin(*EMPTY), value).otherwise(F.lit(json.dumps(rules.placeholder)))


def redact(records: DataFrame, rules: Rules) -> DataFrame:
    """Masks both sides of covered changes, masks covered keys inside other values, and removes covered attributes."""
    if not rules.fields:
        return records
    kind = F.col("objectType")
    nested = _nested(rules)
    side = lambda k, v: F.when(hit(rules, kind, k), mask(rules, v)).otherwise(v)
    changes = F.transform_values("changes", lambda k, c: F.struct(c["pair"].alias("pair"), side(k, c["old"]).alias("old"), side(k, c["new"]).alias("new"), side(k, c["raw"]).alias("raw")))
    out = records.withColumn("changes", changes).withColumn("attributes", F.map_filter("attributes", lambda k, _: ~hit(rules, kind, k)))
    # only values that are containers and hold one of the names need to be opened
    names = sorted({f.rpartition(".")[2] for f in rules.fields})
    holds = lambda v: v.isNotNull() & v.rlike(r"^[\[{]") & v.rlike("|".join('"' + n.replace("\\", "") + '"' for n in names))
    needs = F.exists(F.map_values("changes"), lambda c: F.coalesce(holds(c["old"]), F.lit(False)) | F.coalesce(holds(c["new"]), F.lit(False)) | F.coalesce(holds(c["raw"]), F.lit(False))) | F.exists(F.map_values("attributes"), holds)
    opened = F.from_json(nested(F.col("objectType"), F.to_json("changes", {"ignoreNullFields": "false"})), "map<string,struct<pair:boolean,old:string,new:string,raw:string>>")
    attributes = F.from_json(nested(F.col("objectType"), F.to_json("attributes")), "map<string,string>")
    return out.withColumn("_needs", F.coalesce(needs, F.lit(False))).withColumn("changes", F.when(F.col("_needs"), opened).otherwise(F.col("changes"))).withColumn("attributes", F.when(F.col("_needs"), attributes).otherwise(F.col("attributes"))).drop("_needs")


def redact_value(value: Any, names: set[str], rules: Rules) -> Any:
    """Masks covered keys at any depth of a value; what is too deep or too large is an error, not a leak."""
    nodes = 0

    def walk(x: Any, depth: int) -> Any:
        nonlocal nodes
        nodes += 1
        if depth > rules.max_depth or nodes > rules.max_nodes:
            raise ValueError("the value is too deep or too large to be redacted")
        if isinstance(x, dict):
            return {k: (v if v in (None, "", [], {}) else rules.placeholder) if k in names else walk(v, depth + 1) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, depth + 1) for v in x]
        return x

    return walk(value, 0)


def _nested(rules: Rules):
    @F.pandas_udf("string")
    def nested(object_type: pd.Series, text: pd.Series) -> pd.Series:
        def one(kind: str, data: str | None) -> str | None:
            if data is None:
                return None
            names = rules.names(kind)

            def value(v: Any) -> Any:
                if not isinstance(v, str) or v[:1] not in "[{":
                    return v
                try:
                    inner = json.loads(v)
                except ValueError:
                    return v
                try:
                    return json.dumps(redact_value(inner, names, rules), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
                except ValueError:
                    return json.dumps(rules.placeholder)

            return json.dumps({k: {s: value(x) for s, x in v.items()} if isinstance(v, dict) else value(v) for k, v in json.loads(data).items()})

        return pd.Series([one(k, t) for k, t in zip(object_type, text)])

    return nested


def leaks(df: DataFrame, secrets: Sequence[str]) -> DataFrame:
    """Rows of any table in which one of the secrets is still to be found; for sweeps over every output."""
    whole = F.to_json(F.struct("*"))
    found = F.lit(False)
    for s in secrets:
        found = found | F.contains(whole, F.lit(s))
    return df.where(found)
