"""Exact dedup by most-significant-digit radix partitioning over the bytes of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.llm.common import Scratch, ascii_lower

#: Bytes of the first digit, and how much wider each next one is.
FIRST_DIGIT, WIDER = 64, 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, wider: int = WIDER) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z, and which row of each stays.

    Each level takes the next ``digit`` of the bytes (64, then 512, 4096, ...), splits every open group
    by it, and closes a group that has one row left or whose texts have ended. Equality is by the bytes
    themselves at every level, never by a digest. A level counts its groups with map-side combining, so
    a group with a third of all rows is summed before it is shuffled, and the join that hands the
    counts back has plain exchanges on both sides, which AQE splits where a group is hot. The state
    between levels is a table in the shared folder: only rows of open groups, with the bytes not yet read.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, tie``; tie is the row's place in the input. The row with the
    largest doc_id stays. A null text counts as empty; empty texts are one group. A null doc_id is below
    every other. Rows that repeat both doc_id and text are separate rows of one group, of which one is
    kept. An empty table gives an empty result. Texts of any length are read to their end.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("bytes"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.select("doc_id", F.sha2("bytes", 256).alias("text_sha256"), F.lit(0).cast("long").alias("gid"), F.col("bytes").alias("rest"), "tie")
    level, width, done = 0, first_digit, []
    while True:
        table = scratch.keep(_level(rows, level, width), f"level{level}")
        done.append(table.where("closed").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "tie"))
        rows = table.where("NOT closed").select("doc_id", "text_sha256", F.col("next_gid").alias("gid"), "rest", "rid", "tie")
        if rows.isEmpty():
            break
        level, width = level + 1, width * wider
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # what stays is a narrow table, without the bytes that levels handed on
    out = scratch.keep(out, "result")
    scratch.drop(*[f"level{i}" for i in range(level + 1)])
    return out


def _level(rows: DataFrame, level: int, width: int) -> DataFrame:
    """Splits every group by its next ``width`` bytes. ``rid`` names a row from the first table on."""
    key = F.struct(F.col("gid"), F.substring("rest", 1, width).alias("digit"), (F.octet_length("rest") <= width).alias("ended")).alias("key")
    own = F.monotonically_increasing_id() if level == 0 else F.col("rid")
    counts = rows.select("doc_id", key, own.alias("label")).groupBy("key.gid", "key.digit", "key.ended").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "label")).alias("top"), F.max("label").alias("next_gid"))
    # joined by one struct, so that neither side keeps the exchange of the aggregate and AQE can split both
    counts = counts.select(F.struct("gid", "digit", "ended").alias("key"), "group_size", "top", "next_gid")
    alone = F.col("group_size") == 1
    # at the first level a row has no name yet: groups of several are told apart at the next one
    closed = alone if level == 0 else alone | F.col("ended")
    kept = alone if level == 0 else F.col("rid") == F.col("top.label")
    joined = rows.withColumn("key", key).join(counts, "key").withColumn("ended", F.col("key.ended")).withColumn("closed", closed)
    return joined.select(
        "doc_id", "text_sha256", "tie", "closed", F.when(F.col("closed"), F.col("top.doc_id")).alias("keep_id"), F.when(F.col("closed"), F.col("group_size")).alias("group_size"),
        F.when(F.col("closed"), kept).alias("kept"), "next_gid", F.expr(f"CASE WHEN NOT closed THEN substring(rest, {width + 1}) END").alias("rest"),
        (F.monotonically_increasing_id() if level == 0 else F.col("rid")).alias("rid"))
