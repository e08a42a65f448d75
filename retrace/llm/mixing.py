"""Mixing sources to target weights: a curriculum whose weights change over the training run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.common import WORD, Scratch

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: A source's weight moves in a straight line from its START share of the mean at time 0 to 2 - START
#: at time 1, by its rank: the first of a cycle of three early, the last late.
STARTS = (1.5, 1.0, 0.5)
#: Ranges of the md5 per source whose totals make up the prefix sums: this many, and more as rows grow.
BUCKETS, ROWS_PER_BUCKET = 256, 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size`` to ``source, source_size, weight, rank, target``: words to take of each source.

    ``share`` of all words is split by weight; a target stops at ``most`` times its source and the rest
    is reshared, which has one answer: target = min(most * size, level * weight) with the level that
    spends the budget. Sorting by size / weight, the level is found with running sums. The table has one
    row per source. Sources rank by code point, null last; their weights repeat.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(rank) - 1).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    running = running.withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    running = running.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # the level if this source and all above it are free; it holds from the first source not above its cap
    running = running.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    running = running.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return running.withColumn("at", level).select("source", "source_size", "weight", "rank", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target"))


def training_time(share: Column, start: Column) -> Column:
    """The time at which a source's demand reaches ``share`` (0 to 1) of its target.

    The schedule w(t) = start + (2 - 2 * start) * t integrates to D(t) = start * t + (1 - start) * t^2,
    which is 1 at t = 1 and rises for start in (0, 2); this is its inverse, in the form that is stable
    where the slope is small.
    """
    return 2 * share / (start + F.sqrt(start * start + 4 * (1 - start) * share))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, starts: Sequence[float] = STARTS, buckets: int | None = None, ordered: bool = False) -> DataFrame:
    """One row per document: what of it the mix takes, and when.

    A source's documents stand in a fixed shuffled order (md5 of the id) on a line of words that is
    walked ``most`` times at most; the target is where the walk stops. The words of a copy that lie
    before the stop are taken; only the one document per source in which the walk stops is taken in
    part. The position of a copy is the inverse of the source's cumulative demand at its first word, so
    every source follows its schedule and all end together. Prefix sums are built from totals of
    ``buckets`` ranges of the md5 per source, so a source with a third of all rows spreads over them; their number grows with the rows.
    With ``ordered`` the result is range-partitioned and sorted by the position of each document's first copy, documents that
    are not taken last.

    Returns ``doc_id, tie, source, size, source_size, target, taken, copies``; copies is an array of
    structs (pass, position, words), empty for what is not taken. Size is the number of words, 0 for a
    null text; documents of size 0 are never taken. A null source is a source of its own. Null or
    repeated ids: each row counts by itself; the order among equal ids is by size, then by input order. Empty table: empty
    result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("tie"))
    rows = scratch.keep(rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "rows")
    buckets = buckets or max(BUCKETS, rows.count() // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", (F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "source_size", "rank", "target")
    offsets = scratch.keep(offsets, "offsets")
    own = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("in_bucket", F.sum("size").over(own) - F.col("size")).alias("r")
    placed = placed.join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket"))).select("r.doc_id", "r.tie", "r.source", "size", "source_size", "target", "rank", (F.col("before") + F.col("in_bucket")).alias("start"))
    stop = F.round("target").cast("long")
    start_share = F.element_at(F.array(*[F.lit(float(s)) for s in starts]), (F.col("rank") % len(starts) + 1).cast("int"))
    copies = []
    for turn in range(most):
        at = F.col("start") + turn * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), stop - at)).cast("long")
        copies.append(F.when(words > 0, F.struct(F.lit(turn).alias("pass"), training_time(F.least(F.lit(1.0), at / F.col("target")), start_share).alias("position"), words.alias("words"))))
    placed = placed.withColumn("copies", F.array_compact(F.array(*copies)))
    placed = placed.select("doc_id", "tie", "source", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"), "copies")
    if ordered:
        order = [F.get("copies", F.lit(0))["position"].asc_nulls_last(), F.col("doc_id"), F.col("tie")]
        placed = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return placed


def mixed_documents(docs: DataFrame, partitions: int | None = None, whole: bool = False, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the order of training.

    ``docs`` has to be a stored table: its rows are named by their place in it, in two reads. Rows keep
    all columns of ``docs``; the one copy per source in which the walk stops keeps the text up
    to its last word taken, or with ``whole`` is there whole or not at all, whichever is nearer to the
    target, so no text is ever cut. The result is range-partitioned and sorted by position.
    """
    text_col = options.get("text_col", "text")
    plan = mix(docs, **options).where("taken > 0").select("tie", F.explode("copies").alias("copy"), "size").alias("p")
    if whole:
        plan = plan.where(2 * F.col("copy.words") >= F.col("size")).withColumn("copy", F.col("copy").withField("words", F.col("size")))
    rows = docs.select(F.monotonically_increasing_id().alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(plan, "tie").select("row", "copy", "size")
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("copy.position"), F.col(f"row.`{options.get('id_col', 'doc_id')}`"), F.col("copy.pass")]
    out = out.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    upto = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("copy.words").cast("int")), "")
    text = F.when(F.col("copy.words") < F.col("size"), upto).otherwise(F.col(f"row.`{text_col}`"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
