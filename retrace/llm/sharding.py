"""Contiguous shards of equal bytes, from a global prefix sum built of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.common import Scratch

ROWS_PER_PARTITION = 50_000


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Puts all documents, in the order of doc_id, into ``shards`` contiguous shards of near equal bytes.

    Only id, size and checksum of a document are sorted. The sorted partitions are written once, so that
    totals and rows speak of the same partitions; a prefix sum over one total per partition gives each
    partition its offset, a window inside the partition the rest. A document belongs to the shard in
    which its middle byte falls, so a cut is off its equal target by half a document at most.
    Equal texts are rows like others: a group of copies larger than a shard has to be cut anyway.

    Returns ``doc_id, size, text_crc32, shard, slot``; size is the UTF-8 bytes plus 1 (1 for a null
    text, whose checksum is that of no bytes, 0), slot counts from 0 in each shard without gaps. Null ids
    come first; rows that repeat an id keep separate slots. Empty table: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")), "rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // rows_per_partition + 1)
    # repeated rows differ in tie, so no range holds more than its part of them
    ranged = scratch.keep(rows.repartitionByRange(parts, "doc_id", "size", "text_crc32", "tie").withColumn("part", F.spark_partition_id()), "ranged")
    scratch.drop("rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total"))
    own = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32", "tie")
    placed = ranged.join(offsets, "part").crossJoin(F.broadcast(total)).select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.row_number().over(own)).alias("place"),
        (F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("end"), "total")
    # the middle byte, doubled to stay whole: 2 * end - size of 2 * total
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * end - size) * {shards} div (2 * total)").cast("int")))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
