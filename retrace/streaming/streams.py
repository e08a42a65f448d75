"""The live forms: a stream of log entries becomes settled statements; a queue of records becomes upserts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from retrace.operators.txlog import Log, with_kinds
from retrace.sources.store import Store

SETTLED = "connection string, seq long, fate string, owner long, sql string, params string"
ENTRY = "seq long, kind string, savepoint string, failed boolean, flush long, sql string, params string"


class Settling(StatefulProcessor):
    """Keeps the open transaction of one connection, and emits statements when their fate is known.

    State is what has not settled, so it ends with the transaction; what was emitted is never taken back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "entries string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        entries: list[dict] = json.loads(self.open.get()[0]) if self.open.exists() else []
        new = pd.concat(list(rows)).sort_values("seq")
        entries += json.loads(new[["seq", "kind", "savepoint", "failed", "flush", "sql", "params"]].to_json(orient="records"))
        log, settled = Log(), []
        keep = 0
        for i, e in enumerate(entries):
            settled += log.take(int(e["seq"]), e["kind"], e["savepoint"], bool(e["failed"]), e["flush"])
            if not log.frames and not any(f is not None for f in log.flushes):
                keep = i + 1
        by_seq = {e["seq"]: e for e in entries[:keep]}
        out = [(key[0], seq, fate, owner, by_seq[seq]["sql"], by_seq[seq]["params"]) for seq, fate, owner, _ in sorted(settled) if seq in by_seq]
        rest = entries[keep:]
        if rest:
            self.open.update((json.dumps(rest),))
        elif self.open.exists():
            self.open.clear()
        yield pd.DataFrame(out, columns=["connection", "seq", "fate", "owner", "sql", "params"]).astype({"seq": "int64", "owner": "Int64"})

    def close(self) -> None:
        pass


def settled_stream(entries: DataFrame) -> DataFrame:
    """A stream of log entries (connection, seq, sql, params as JSON text, failed, kind, flush) to settled statements, each once."""
    rows = with_kinds(entries).select("connection", "seq", "kind", "savepoint", F.coalesce("failed", F.lit(False)).alias("failed"), "flush", "sql", "params")
    return rows.groupBy("connection").transformWithStateInPandas(Settling(), SETTLED, "Append", "None")


def once_by_id(records: DataFrame, within: str = "1 day") -> DataFrame:
    """Drops records of an id that has been seen, with state bounded by the watermark; late ones pass, history is never dropped for its age."""
    return records.withWatermark("loggedAt", within).dropDuplicatesWithinWatermark(["id"])


def upsert_stream(records: DataFrame, store: Store, routes: Sequence[str], checkpoint: str, stamp: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """A queue of routed records into the store. A batch is one commit of the batch's name, so a retried batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = (stamp(rows) if stamp else rows).persist()
        try:
            store.upsert(rows, routes, f"{number:020d}")
        finally:
            rows.unpersist()

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def coalesced_batches(entries: DataFrame, sink: Callable[[DataFrame, int], None], merge: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """One coalescing frame per micro-batch, released at its end: what a batch left open is written, not dropped."""
    return entries.writeStream.foreachBatch(lambda rows, n: sink(merge(rows.withColumn("frame", F.lit(n))), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
