"""Coalescing: the many small records of one operation become one record per object.

``coalesce_records`` says the rules with windows and aggregates and covers every frame that never reaches its
valve. ``fold_frames`` is an ordered fold per frame, for frames that hold more objects than they may and for atomic frames.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.errors import FrameOverflow
from retrace.functions.values import same
from retrace.operators.folds import fold_ordered

MAX_HELD = 10_000
OBJECT = ["frame", "objectType", "objectId"]


def no_attributes() -> Column:
    return F.create_map().cast("map<string,string>")


def segments(steps: DataFrame) -> DataFrame:
    """Numbers the records of each object into segments: a remove stands alone, another actor begins anew.

    Adds seg, first_touch (of the object since its last remove), and is what both forms build on.
    """
    own = Window.partitionBy(*OBJECT).orderBy("seq")
    before_event, before_actor = F.lag("event").over(own), F.lag("actor").over(own)
    first = F.row_number().over(own) == 1
    breaks = first | (before_event == "remove") | (F.col("event") == "remove") | ~F.col("actor").eqNullSafe(before_actor)
    epoch = (first | (before_event == "remove")).cast("int")
    out = steps.withColumn("_break", breaks.cast("int")).withColumn("_epoch", epoch)
    out = out.withColumn("seg", F.sum("_break").over(own)).withColumn("_epoch", F.sum("_epoch").over(own))
    return out.withColumn("first_touch", F.min("seq").over(Window.partitionBy(*OBJECT, "_epoch"))).drop("_break", "_epoch")


def coalesce_records(steps: DataFrame, numeric: Sequence[str] = (), comparators: Sequence[Callable[..., Column]] = (), types: Sequence[str] = ()) -> DataFrame:
    """``frame, objectType, objectId, event, actor, id, loggedAt, seq, changes, attributes, place`` of every record that is written.

    ``steps`` has the columns of ``records`` with changes as a map of change structs and attributes as a map. A field keeps its
    earliest old value since the last free-form value and its latest new one; a pair that moved and came back is dropped,
    one that never moved is context and stays; an update with nothing changed is no record. ``types`` are the
    object types that are coalesced, all if empty; others pass. place orders the records as the frame releases them.
    """
    passing = steps.where(~F.col("objectType").isin(*types)) if types else None
    steps = segments(steps.where(F.col("objectType").isin(*types)) if types else steps)
    key = [*OBJECT, "seg"]
    heads = steps.groupBy(*key).agg(
        F.min("seq").alias("seq"), F.min_by("event", "seq").alias("event"), F.min_by("actor", "seq").alias("actor"), F.min_by("id", "seq").alias("id"), F.min_by("loggedAt", "seq").alias("loggedAt"), F.min("first_touch").alias("first_touch"),
        # the attributes of the first step, overlaid by those of the later ones in turn
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.map_entries(F.coalesce("attributes", no_attributes())).alias("entries")))), lambda x: F.map_from_entries(x["entries"])), no_attributes(), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m)).alias("attributes"))
    heads = heads.withColumn("next_seq", F.lead("seq").over(Window.partitionBy(*OBJECT).orderBy("seg")))
    steps_of = steps.select(*key, "seq", F.col("event").alias("_event"), F.explode("changes").alias("field", "change"))
    # pairs before the last free-form value of a field say nothing about what it was
    fields = Window.partitionBy(*key, "field").orderBy("seq")
    free = F.max(F.when(~F.col("change.pair"), F.col("seq"))).over(fields.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    merged = steps_of.withColumn("_free", F.coalesce(free, F.lit(-1))).groupBy(*key, "field").agg(
        F.min("seq").alias("seen"), F.max_by("change", "seq").alias("last"), F.min_by("change.old", F.when(F.col("change.pair") & (F.col("seq") > F.col("_free")), F.col("seq"))).alias("old"),
        F.bool_or(F.col("change.pair") & ~F.col("change.old").eqNullSafe(F.col("change.new"))).alias("moved"), F.first("_event").alias("_event"))
    pair = F.col("last.pair")
    equal = pair & same(F.col("objectType"), F.col("field"), F.col("old"), F.col("last.new"), numeric, comparators)
    keep = (F.col("_event") == "remove") | ~(equal & F.col("moved"))
    change = F.struct(pair.alias("pair"), F.when(pair, F.col("old")).alias("old"), F.when(pair, F.col("last.new")).alias("new"), F.when(~pair, F.col("last.raw")).alias("raw"))
    kept = merged.where(keep).withColumn("_changed", ~equal).groupBy(*key).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("seen", "field", change.alias("change")))), lambda x: F.struct(x["field"], x["change"]))).alias("changes"), F.bool_or("_changed").alias("changed"))
    out = heads.join(kept, key, "left").where((F.col("event") != "update") | F.coalesce("changed", F.lit(False)))
    removed = F.col("event") == "remove"
    place = F.struct(F.when(removed, F.col("seq")).otherwise(F.coalesce("next_seq", F.lit(2**62))).alias("at"), removed.cast("int").alias("after"), "first_touch")
    empty = F.create_map().cast("map<string,struct<pair:boolean,old:string,new:string,raw:string>>")
    columns = ["frame", "objectType", "objectId", "event", "actor", "id", "loggedAt", "seq", "changes", "attributes", "place"]
    out = out.withColumn("changes", F.coalesce("changes", empty)).withColumn("place", place).select(*columns)
    if passing is not None:
        out = out.unionByName(passing.withColumn("place", F.struct(F.col("seq").alias("at"), F.lit(0).alias("after"), F.col("seq").alias("first_touch"))).select(*columns))
    return out


def crowded_frames(steps: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """Frames that name more objects than may be held: only these need the fold."""
    return steps.groupBy("frame").agg(F.count_distinct("objectType", "objectId").alias("objects")).where(F.col("objects") > max_held).select("frame")


class Fold:
    """One frame in order, record by record, with its valve. ``changes`` are dicts of field to {pair, old, new, raw}.

    The valve: a new object that would be one too many first releases all that is held. An atomic frame stages what it
    releases early, counts it towards the valve, and fails whole when it overflows.
    """

    def __init__(self, max_held: int = MAX_HELD, atomic: bool = False, comparator: Callable[[str, str, str | None, str | None], bool | None] | None = None):
        self.max_held, self.atomic, self.comparator = max_held, atomic, comparator
        self.held: dict[tuple, dict] = {}
        self.out: list[dict] = []

    def agrees(self, record: dict, field: str, old: str | None, new: str | None) -> bool:
        said = self.comparator(record["objectType"], field, old, new) if self.comparator else None
        return old == new if said is None else said

    def release(self, record: dict) -> None:
        changes, changed = {}, False
        for name, change in record["changes"].items():
            equal = change["pair"] and self.agrees(record, name, change["old"], change["new"])
            if equal and record["moved"].get(name):
                continue
            changed = changed or not equal
            changes[name] = change
        if changed or record["event"] != "update":
            self.out.append({**{k: v for k, v in record.items() if k != "moved"}, "changes": changes})

    def release_all(self) -> None:
        for record in self.held.values():
            self.release(record)
        self.held.clear()

    @staticmethod
    def strict(changes: dict) -> dict[str, bool]:
        return {k: bool(c["pair"] and c["old"] != c["new"]) for k, c in changes.items()}

    def merge(self, record: dict, step: dict) -> None:
        for name, change in step["changes"].items():
            now = record["changes"].get(name)
            if now is not None and now["pair"] and change["pair"]:
                record["changes"][name] = {**change, "old": now["old"]}
            else:
                record["changes"][name] = change
            record["moved"][name] = record["moved"].get(name, False) or self.strict({name: change})[name]
        record["attributes"] = {**record["attributes"], **step["attributes"]}

    def check(self, more: int = 0) -> None:
        if self.atomic and len(self.held) + len(self.out) + more > self.max_held:
            raise FrameOverflow(f"more than {self.max_held} records in an atomic frame")

    def step(self, step: dict) -> None:
        key = (step["objectType"], step["objectId"])
        step = {**step, "changes": dict(step["changes"]), "attributes": dict(step["attributes"])}
        if step["event"] == "remove":
            if key in self.held:
                self.release(self.held.pop(key))
            self.out.append(step)
            self.check()
            return
        if key in self.held:
            now = self.held[key]
            if now["actor"] == step["actor"]:
                self.merge(now, step)
                return
            self.release(now)
            self.held[key] = {**step, "moved": self.strict(step["changes"])}
            self.check()
            return
        self.check(1)
        if not self.atomic and len(self.held) >= self.max_held:
            self.release_all()
        self.held[key] = {**step, "moved": self.strict(step["changes"])}


def released(rows: Iterable[dict], max_held: int = MAX_HELD, atomic: bool = False, comparator: Callable[[str, str, str | None, str | None], bool | None] | None = None) -> Iterator[dict]:
    """``Fold`` over the rows of one frame: records as they are released, of an atomic frame all at its end or none."""
    state = Fold(max_held, atomic, comparator)
    for row in rows:
        state.step(row)
        if not atomic:
            yield from state.out
            state.out.clear()
    state.release_all()
    yield from state.out


def fold(rows: Iterable[dict], max_held: int = MAX_HELD, atomic: bool = False, comparator: Callable[[str, str, str | None, str | None], bool | None] | None = None) -> list[dict]:
    """All that one frame releases."""
    return list(released(rows, max_held, atomic, comparator))


FOLDED = "frame string, objectType string, objectId string, event string, actor string, id string, loggedAt string, seq long, changes string, attributes string, place long, failure string"


def fold_frames(steps: DataFrame, max_held: int = MAX_HELD, atomic: bool = False, comparator: Callable[..., bool | None] | None = None) -> DataFrame:
    """``fold`` for every frame: changes and attributes come back as JSON, place counts in the frame. An overflown atomic frame is one row with its failure.

    A frame is one unit of work, read in order by one task, which holds no more of it than the frame may; give it the crowded frames only.
    """
    rows = steps.select(F.col("frame").cast("string").alias("frame"), "objectType", "objectId", "event", "actor", "id", F.col("loggedAt").cast("string").alias("loggedAt"), "seq", F.to_json("changes", {"ignoreNullFields": "false"}).alias("changes"), F.to_json("attributes").alias("attributes"))

    def run(key: tuple, frame: Iterator[dict]) -> Iterator[tuple]:
        steps = ({**r, "changes": json.loads(r["changes"] or "{}"), "attributes": json.loads(r["attributes"] or "{}")} for r in frame)
        try:
            for place, r in enumerate(released(steps, max_held, atomic, comparator)):
                yield (key[0], *[r[n] for n in ("objectType", "objectId", "event", "actor", "id", "loggedAt", "seq")], json.dumps(r["changes"]), json.dumps(r["attributes"]), place, None)
        except FrameOverflow as e:
            yield (key[0], *[None] * 10, str(e))

    return fold_ordered(rows, ["frame"], ["seq"], run, FOLDED)


def valve_turns(steps: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """``steps`` with ``turn``: how often the valve of its frame had opened before each record.

    Between two openings a frame merges by its rules alone, so each turn is a frame of its own to ``coalesce_records``. A task holds the
    names of the objects that are held, at most as many as may be.
    """

    def run(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        held, turn = set(), 0
        for r in rows:
            own = (r["objectType"], r["objectId"])
            if r["event"] == "remove":
                held.discard(own)
            elif own not in held:
                if held and len(held) >= max_held:
                    held, turn = set(), turn + 1
                held.add(own)
            yield key[0], r["seq"], turn

    seen = fold_ordered(steps.select("frame", "objectType", "objectId", "event", "seq"), ["frame"], ["seq"], run, "frame string, seq long, turn int")
    return steps.join(seen, ["frame", "seq"])


def coalesce_valved(steps: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """``frame, objectType, objectId, event, id, place`` of every frame: the crowded ones by the fold, all others by windows.

    place counts the records of a frame as it releases them, from 0.
    """
    crowded = crowded_frames(steps, max_held).select(F.col("frame").alias("crowded"))
    kind = F.col("frame").eqNullSafe(F.col("crowded"))
    folded = fold_frames(steps.join(crowded, kind, "left_semi"), max_held)
    others = coalesce_records(steps.join(crowded, kind, "left_anti"))
    others = others.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy("place")).cast("long") - 1)
    columns = ["frame", "objectType", "objectId", "event", "id", "place"]
    return folded.select(*columns).unionByName(others.withColumn("frame", F.col("frame").cast("string")).select(*columns))


def model(steps: Sequence[dict]) -> Iterator[dict]:
    """The rules without a valve, for one frame; used to hold the set-based form against."""
    yield from fold(steps, 1 << 60)
