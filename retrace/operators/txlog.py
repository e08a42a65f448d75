"""Fate and ownership: which statements stood, and which unit of work they belong to."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.functions.sqlshape import control_kind, savepoint_name

COMMITTED, VOID, PENDING = "COMMITTED", "VOID", "PENDING"
CONTROLS = ("begin", "commit", "rollback", "savepoint", "release", "rollback_to", "flush_start", "flush_claim", "flush_end")
FATES = "connection string, seq long, fate string, owner long, depth int"


class Log:
    """One connection's open transaction: a stack of frames and of flushes, and the statements not yet settled.

    A savepoint's name may repeat; it means the innermost one of its name. Rolling back to it voids what ran since and
    keeps it open; releasing it hands its statements outward. Only the outermost commit or rollback settles.
    """

    def __init__(self) -> None:
        self.frames: list[tuple[str | None, list[list]]] = []  # savepoint name, its statements
        self.flushes: list[int | None] = []

    def take(self, seq: int, kind: str, name: str | None, failed: bool, flush: int | None) -> Iterator[tuple]:
        """Takes the next entry; yields what is settled by it: seq, fate, owner, depth."""
        if kind == "begin":
            if not self.frames:
                self.frames.append((None, []))
        elif kind in ("commit", "rollback"):
            for _, own in self.frames:
                for s in own:
                    yield s[0], s[1] or (COMMITTED if kind == "commit" else VOID), s[2], s[3]
            self.frames.clear()
        elif kind == "savepoint":
            if self.frames:
                self.frames.append((name, []))
        elif kind in ("release", "rollback_to"):
            at = next((i for i in range(len(self.frames) - 1, 0, -1) if self.frames[i][0] == name), None)
            if at is not None:
                inner = [s for _, own in self.frames[at:] for s in own]
                del self.frames[at:]
                if kind == "rollback_to":
                    for s in inner:
                        s[1] = VOID
                    self.frames[-1][1].extend(inner)
                    self.frames.append((name, []))
                else:
                    self.frames[-1][1].extend(inner)
        elif kind == "flush_start":
            self.flushes.append(flush)
        elif kind == "flush_end":
            if self.flushes:
                self.flushes.pop()
        elif kind == "flush_claim":
            for _, own in self.frames:
                for s in own:
                    if s[2] is None:
                        s[2] = flush
        else:
            owner = flush if flush is not None else self.flushes[-1] if self.flushes else None
            if self.frames:
                self.frames[-1][1].append([seq, VOID if failed else None, owner, len(self.frames)])
            else:
                yield seq, VOID if failed else COMMITTED, owner, 0

    def pending(self) -> Iterator[tuple]:
        for _, own in self.frames:
            for s in own:
                yield s[0], s[1] or PENDING, s[2], s[3]


def settle(rows: Iterable[tuple]) -> list[tuple]:
    """All entries (seq, kind, savepoint, failed, flush) of a connection in order: fates by seq."""
    log, out = Log(), []
    for row in rows:
        out += log.take(*row)
    return sorted([*out, *log.pending()])


def with_kinds(statements: DataFrame) -> DataFrame:
    """Kind of every entry, from the marker or from the text; and the savepoint it names."""
    text = F.coalesce(F.col("sql"), F.lit(""))
    kind = F.when(F.coalesce("kind", F.lit("statement")) == "statement", F.coalesce(control_kind(text), F.lit("statement"))).otherwise(F.col("kind"))
    return statements.withColumn("kind", kind).withColumn("savepoint", savepoint_name(text))


def fates(statements: DataFrame, include_pending: bool = False) -> DataFrame:
    """``connection, seq, fate, owner, depth`` of every statement.

    The log of a connection is cut where no transaction and no flush is open, found by running sums, so a fold reads one
    transaction and not a connection's whole life. Pending statements are left out unless asked for.
    """
    rows = with_kinds(statements).select("connection", "seq", "kind", "savepoint", F.coalesce("failed", F.lit(False)).alias("failed"), "flush")
    own = Window.partitionBy("connection").orderBy("seq")
    # an outermost transaction ends at the first commit or rollback, whatever was begun again inside it
    tx = F.when(F.col("kind") == "begin", F.lit(True)).when(F.col("kind").isin("commit", "rollback"), F.lit(False))
    rows = rows.withColumn("_open", F.coalesce(F.last(tx, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    rows = rows.withColumn("_flushes", F.coalesce(F.sum(F.when(F.col("kind") == "flush_start", 1).when(F.col("kind") == "flush_end", -1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("part", F.sum((~F.col("_open") & (F.col("_flushes") <= 0)).cast("int")).over(own))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        found = settle((int(r.seq), r.kind, r.savepoint, bool(r.failed), None if pd.isna(r.flush) else int(r.flush)) for r in part.itertuples())
        return pd.DataFrame([(key[0], *x) for x in found], columns=["connection", "seq", "fate", "owner", "depth"]).astype({"owner": "Int64"})

    # a part without savepoints and flush marks says its fate by how it ends; only the others are folded
    whole = Window.partitionBy("connection", "part")
    plain_kinds = F.max((~F.col("kind").isin("statement", "begin", "commit", "rollback")).cast("int")).over(whole) == 0
    ended = {k: F.max((F.col("kind") == k).cast("int")).over(whole) == 1 for k in ("begin", "commit", "rollback")}
    rows = rows.withColumn("_plain", plain_kinds).withColumn("_fate", F.when(ended["rollback"], VOID).when(ended["commit"] | ~ended["begin"], COMMITTED).otherwise(PENDING)).withColumn("_depth", ended["begin"].cast("int"))
    plain = rows.where(F.col("_plain") & (F.col("kind") == "statement")).select("connection", "seq", F.when(F.col("failed"), VOID).otherwise(F.col("_fate")).alias("fate"), F.col("flush").cast("long").alias("owner"), F.col("_depth").alias("depth"))
    out = rows.where(~F.col("_plain")).select("connection", "part", "seq", "kind", "savepoint", "failed", "flush").groupBy("connection", "part").applyInPandas(run, FATES).unionByName(plain)
    return out if include_pending else out.where(F.col("fate") != PENDING)
