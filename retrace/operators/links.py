"""Many-to-many links: an account per association and owner, and what each unit of work did to it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.operators.folds import fold_ordered

#: Keys that are compared as numbers.
NUMERIC = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")

RUNS = "association string, owner string, flush long, since long, run int, old array<string>, new array<string>, doubt string, taken array<long>"


def in_order(target: str) -> tuple:
    """Where a target stands in a list: numbers by value and before all text, text by code point."""
    return (0, float(target), target) if NUMERIC.fullmatch(target) else (1, 0.0, target)


def sorted_targets(targets: Column) -> Column:
    """A list of targets in the order of ``in_order``."""
    numeric = lambda t: t.rlike(f"^(?:{NUMERIC.pattern})$")
    place = lambda t: F.struct((~numeric(t)).cast("int").alias("text"), F.when(numeric(t), t.cast("double")).otherwise(F.lit(0.0)).alias("number"), t.alias("target"))
    return F.transform(F.array_sort(F.transform(targets, place)), lambda p: p["target"])


def undone(steps: Sequence[tuple], targets: Iterable[str], includes: Iterable[int]) -> set[str] | None:
    """What an account held before the statements it already includes, latest first; None if one of them is no link that came or went."""
    by = {s[0]: s for s in steps}
    state = set(targets)
    for seq in sorted(includes, reverse=True):
        step = by.get(seq)
        if step is None or step[2] not in ("add", "remove"):
            return None
        (state.discard if step[2] == "add" else state.add)(step[3])
    return state


def link_runs(steps: Iterable[tuple], account: Iterable[str] | None) -> list[tuple]:
    """One account in order. Steps are (seq, flush, kind, target, observed), kinds:

    add and remove of one link; emptied (all of the owner), gone (the target was deleted with its links; observed says if it was held,
    null if nobody looked), row (the owner's row arrived, with no links), row gone (it was deleted), begin (another flush starts). An unknown
    account is None: links that come and go are known one by one, whole lists are not. What emptied a list right before its owner was deleted
    is part of that deletion and no run of its own. A contradiction makes the account unknown and is a doubt. A run ends when the flush
    changes, one begins in between, or a link is met twice. ``taken`` has the places at which a deleted target was taken out.
    """
    state = None if account is None else set(account)
    runs: list[dict] = []
    now: dict | None = None
    met: set[str] = set()
    emptied: dict | None = None  # what the last step emptied, until another step stands after it

    def close() -> None:
        nonlocal now
        if now is not None:
            runs.append(now)
        now = None
        met.clear()

    def contribute(seq: int, flush: int | None, target: str, arrives: bool, cause: str) -> None:
        nonlocal now
        if now is None or now["flush"] != flush or target in met:
            close()
            now = {"flush": flush, "since": seq, "before": None if state is None else set(state), "out": [], "in": [], "doubt": None, "taken": []}
        met.add(target)
        now["in" if arrives else "out"].append(target)
        if cause == "gone":
            now["taken"].append(seq)

    def doubt(seq: int, flush: int | None, text: str) -> None:
        nonlocal state
        close()
        state = None
        runs.append({"flush": flush, "since": seq, "before": None, "out": [], "in": [], "doubt": text, "taken": []})

    for seq, flush, kind, target, observed in steps:
        just, emptied = emptied, None
        if kind == "begin":
            close()
        elif kind == "row":
            state = set()
        elif kind == "row gone":
            if just is not None and now is not None:
                # the run as it was before its list was emptied
                now["out"], now["in"], now["taken"] = just["out"], just["in"], just["taken"]
                if not now["out"] and not now["in"]:
                    now = None
            close()
            state = None if state is None else set()
        elif kind == "add":
            if state is not None and target in state:
                doubt(seq, flush, "a link arrived that was there")
            else:
                contribute(seq, flush, target, True, kind)
                if state is not None:
                    state.add(target)
        elif kind == "remove":
            if state is not None and target not in state:
                doubt(seq, flush, "a link left that was not there")
            else:
                contribute(seq, flush, target, False, kind)
                if state is not None:
                    state.discard(target)
        elif kind == "emptied":
            if state is None:
                doubt(seq, flush, "an unknown list was emptied")
            else:
                if state & met:
                    close()
                emptied = {"out": list(now["out"]), "in": list(now["in"]), "taken": list(now["taken"])} if now is not None and now["flush"] == flush else {"out": [], "in": [], "taken": []}
                for t in sorted(state, key=in_order):
                    contribute(seq, flush, t, False, kind)
            state = set()
        elif kind == "gone":
            held = observed if observed is not None else None if state is None else target in state
            if held is None:
                doubt(seq, flush, "nobody looked who held the target")
            elif held:
                contribute(seq, flush, target, False, kind)
                if state is not None:
                    state.discard(target)
    close()
    out = []
    for i, r in enumerate(runs):
        before = r["before"]
        old = sorted(before if before is not None else r["out"], key=in_order)
        new = sorted((before - set(r["out"])) | set(r["in"]) if before is not None else r["in"], key=in_order)
        out.append((r["flush"], r["since"], i, None if r["doubt"] else old, None if r["doubt"] else new, r["doubt"], r["taken"]))
    return out


def runs_of(steps: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """``link_runs`` for every (association, owner): an account is one owner's links, folded in order.

    steps: association, owner, seq, flush, kind, target, observed; accounts: association, owner, targets (null: unknown) and, if an account
    was taken while the log was running, includes: the places of the statements it shows already, which are undone first.
    """
    rows = steps.select("association", "owner", "seq", "flush", "kind", "target", "observed")
    if accounts is not None:
        known = accounts if "includes" in accounts.columns else accounts.withColumn("includes", F.array().cast("array<long>"))
        rows = rows.join(known.select("association", "owner", "targets", "includes"), ["association", "owner"], "left")
    else:
        rows = rows.withColumn("targets", F.lit(None).cast("array<string>")).withColumn("includes", F.lit(None).cast("array<long>"))

    def run(key: tuple, part: Iterator[dict[str, Any]]) -> Iterable[tuple]:
        part = list(part)
        own = [(r["seq"], r["flush"], r["kind"], r["target"], r["observed"]) for r in part]
        targets, includes = part[0]["targets"], part[0]["includes"] or ()
        for found in link_runs(own, targets if targets is None or not includes else undone(own, targets, includes)):
            yield (*key, *found)

    return fold_ordered(rows, ["association", "owner"], ["seq"], run, RUNS)


def reconciled(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """``association, seq, text``: doubts about statements that took a deleted target out of another number of lists than were known to hold it.

    steps: association, seq, kind, affected (null: not counted) of the statements; a row for each owner asked is fine.
    """
    said = runs.select("association", F.explode("taken").alias("seq")).groupBy("association", "seq").agg(F.count("*").alias("said"))
    asked = steps.where("kind = 'gone' AND affected IS NOT NULL").groupBy("association", "seq").agg(F.max("affected").alias("affected"))
    both = asked.join(said, ["association", "seq"], "left").withColumn("said", F.coalesce("said", F.lit(0)))
    return both.where("said <> affected").select("association", "seq", F.concat(F.lit("a target was taken out of "), F.col("affected"), F.lit(" lists, and "), F.col("said"), F.lit(" were known to hold it")).alias("text"))


def net_links(steps: DataFrame) -> DataFrame:
    """The set-based form for accounts that begin empty and have only add and remove: ``association, owner, flush, old, new``.

    Each link's presence before and after a flush comes from windows per link, so nothing is folded; lists are sorted, numbers by value.
    """
    own = Window.partitionBy("association", "owner", "target").orderBy("seq")
    present = steps.withColumn("_before", F.coalesce(F.lag(F.col("kind") == "add").over(own), F.lit(False)))
    per = Window.partitionBy("association", "owner", "target", "flush").orderBy("seq")
    first = present.withColumn("_first", F.first("_before").over(per)).groupBy("association", "owner", "flush", "target").agg(F.min_by("_before", "seq").alias("before"), F.max_by(F.col("kind") == "add", "seq").alias("after"), F.min("seq").alias("since"))
    moved = first.where("before <> after")
    return moved.groupBy("association", "owner", "flush").agg(F.min("since").alias("since"), sorted_targets(F.collect_list(F.when(F.col("before"), F.col("target")))).alias("old"), sorted_targets(F.collect_list(F.when(F.col("after"), F.col("target")))).alias("new"))


def holders(rows: DataFrame, targets: DataFrame, association: str) -> DataFrame:
    """Owners that hold any of the targets: a semi-join of the association's rows (owner, target)."""
    return rows.join(targets.select("target").distinct(), "target", "left_semi").select(F.lit(association).alias("association"), "owner", "target")


def departed(before: DataFrame, observed: DataFrame) -> DataFrame:
    """Links (association, owner, target) that an observation right after a DELETE no longer shows."""
    return before.join(observed.select("association", "owner", "target"), ["association", "owner", "target"], "left_anti")
