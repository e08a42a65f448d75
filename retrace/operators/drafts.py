"""Drafts: everything one unit of work did to one object becomes one record."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.operators.folds import fold_ordered
from retrace.operators.replay import Mapped, as_of

CHANGES = "map<string,struct<pair:boolean,old:string,new:string,raw:string>>"


def _pairs(old: str, new: str):
    return F.struct(F.lit(True).alias("pair"), F.coalesce(old, F.lit("null")).alias("old"), F.coalesce(new, F.lit("null")).alias("new"), F.lit(None).cast("string").alias("raw"))


def element_runs(changes: DataFrame) -> DataFrame:
    """``objectType, objectId, flush, since, run, changes`` of element changes: a change key that the current run has begins the next one.

    Changes without a flush belong to nobody and are left out. Where a run begins follows from all before it, so runs are numbered in order,
    with the keys of one run in memory.
    """

    def number(key: tuple, rows: Iterator[dict[str, Any]]) -> Iterable[tuple]:
        run, met = 1, set()
        for r in rows:
            if r["name"] in met:
                run, met = run + 1, set()
            met.add(r["name"])
            yield (*key, run, r["seq"], r["name"], r["old"], r["new"])

    of = ["objectType", "objectId", "flush"]
    rows = changes.where(F.col("flush").isNotNull()).select(*of, "seq", "name", "old", "new")
    numbered = fold_ordered(rows, of, ["seq", "name", "old", "new"], number, "objectType string, objectId string, flush long, run int, seq long, name string, old string, new string")
    return numbered.groupBy(*of, "run").agg(F.min("seq").alias("since"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", _pairs("old", "new").alias("change"))))).alias("changes"))


def link_changes(runs: DataFrame, object_type: str, field: str) -> DataFrame:
    """Link runs (see ``links.runs_of``) as runs of an owner's field: whole lists, old and new. Doubts are left out."""
    text = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>")))
    change = F.struct(F.lit(True).alias("pair"), text(F.col("old")).alias("old"), text(F.col("new")).alias("new"), F.lit(None).cast("string").alias("raw"))
    kept = runs.where("doubt IS NULL AND flush IS NOT NULL")
    return kept.select(F.lit(object_type).alias("objectType"), F.col("owner").alias("objectId"), "flush", F.row_number().over(Window.partitionBy("owner", "flush").orderBy("run")).alias("run"), "since", F.create_map(F.lit(field), change).alias("changes"))


def drafts(records: DataFrame, *runs: DataFrame) -> DataFrame:
    """Records with the runs of their elements and links: one draft per object and unit of work.

    The first run joins the object's first record of the unit that is no remove; later runs, and runs without a record, are
    updates of their own. An object removed in the same unit takes nothing in and its runs go. Drafts are ordered by their first fact.
    """
    own = Window.partitionBy("objectType", "objectId", "flush")
    base = records.select("objectType", "objectId", "flush", "event", F.col("seq").alias("since"), "changes")
    base = base.withColumn("removed", F.max((F.col("event") == "remove").cast("int")).over(own)).withColumn("rank", F.row_number().over(own.orderBy((F.col("event") == "remove").cast("int"), "since")))
    for more in runs:
        gone = base.where("event = 'remove'").select("objectType", "objectId", "flush").distinct()
        more = more.join(gone, ["objectType", "objectId", "flush"], "left_anti").select("objectType", "objectId", "flush", "run", F.col("since").alias("run_since"), F.col("changes").alias("run_changes"))
        joined = base.join(more.where("run = 1").drop("run").withColumn("rank", F.lit(1)), ["objectType", "objectId", "flush", "rank"], "full")
        changes = F.map_concat(F.map_filter(F.coalesce("run_changes", F.create_map().cast(CHANGES)), lambda k, _: ~F.map_contains_key(F.coalesce("changes", F.create_map().cast(CHANGES)), k)), F.coalesce("changes", F.create_map().cast(CHANGES)))
        joined = joined.select("objectType", "objectId", "flush", F.coalesce("event", F.lit("update")).alias("event"), F.least("since", "run_since").alias("since"), changes.alias("changes"), F.coalesce("removed", F.lit(0)).alias("removed"), "rank")
        later = more.where("run > 1").select("objectType", "objectId", "flush", F.lit("update").alias("event"), F.col("run_since").alias("since"), F.col("run_changes").alias("changes"), F.lit(0).alias("removed"), (F.col("run") + 1000).alias("rank"))
        base = joined.unionByName(later)
    return base.select("objectType", "objectId", "flush", "event", "since", "changes")


def always_of(mappings: Sequence[Mapped]) -> dict[str, list[str]]:
    """The columns that declarations always record, by object type."""
    out: dict[str, list[str]] = {}
    for m in mappings:
        out.setdefault(m.object_type, []).extend(m.always)
    return out


def with_context(records: DataFrame, versions: DataFrame, always: dict[str, list[str]]) -> DataFrame:
    """Adds the fields that are always recorded to records in which something changed, as they stood at the record: old = new.

    versions is a table of images (objectType, key, valid_from, valid_to, row); a record meets the image of its own type that holds at its
    place, the latest one if there are several. One window carries it forward: one row out for each record.
    """
    images = versions.select("objectType", F.col("key").alias("objectId"), "valid_from", "valid_to", "row")
    out = as_of(records, images, ["objectType", "objectId"], "seq", "valid_from", ["row", "valid_to"])
    rows = F.when(F.col("valid_to").isNull() | (F.col("seq") < F.col("valid_to")), F.col("row"))
    context = F.create_map().cast(CHANGES)
    for kind, fields in always.items():
        if fields:
            entries = F.map_from_entries(F.array(*[F.struct(F.lit(f).alias("key"), _pairs(F.try_element_at(rows, F.lit(f)), F.try_element_at(rows, F.lit(f))).alias("value")) for f in dict.fromkeys(fields)]))
            context = F.when(F.col("objectType") == kind, F.map_filter(entries, lambda k, c: c["old"] != "null")).otherwise(context)
    own = F.col("changes")
    merged = F.when(F.size(own) > 0, F.map_concat(own, F.map_filter(context, lambda k, _: ~F.map_contains_key(own, k)))).otherwise(own)
    return out.select(*[merged.alias("changes") if c == "changes" else F.col(c) for c in records.columns])


def nobodys(bound: DataFrame, owners: DataFrame) -> DataFrame:
    """``connection, seq, root, text`` of statements on followed rows that no unit of work owns: names only, never values."""
    unowned = owners.where("owner IS NULL AND fate = 'COMMITTED'").select("connection", "seq")
    return bound.join(unowned, ["connection", "seq"], "left_semi").where("binding <> 'UNBOUND'").select("connection", "seq", "root", F.concat(F.lower("statement"), F.lit(" on "), F.col("root"), F.lit(" belongs to no unit of work")).alias("text"))
