"""What several operators of this subpackage share: shared-folder tables and small expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Spark's setting by which an execution removes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a run of bytes other than these; bytes.split() of Python knows the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if found is None:
        found = "file://" + tempfile.mkdtemp(prefix="retrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables an operator writes on its way, in the shared folder, so that a lost executor costs one stage.

    ``drop`` removes a table that nothing reads any more; what the result still reads stays. Rows that are named by
    their place in a stored table get the same name in every scan as long as files are split alike, so the
    one setting that follows the number of executors alive is held where it stands.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", spark.sparkContext.defaultParallelism)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back. The shuffle files behind it go as soon as it is written, as nothing reads them again."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does that by itself where every character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions that grow with the input: as many as its splits, or as the session asks."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
