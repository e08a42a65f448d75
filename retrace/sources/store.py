"""A store of record tables on Parquet, and the sinks that write into it.

A table is a directory of commits. Each write adds one commit, a directory with its data and, written last, a marker; readers see
commits with a marker only. That makes a write atomic, lets a snapshot be the list of commits at one moment, and makes an
upsert a matter of reading: of the rows of one id the one of the latest commit counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrace.errors import InvalidRecord, TableNotFound, TransactionSpoilt
from retrace.sources.schema import Difference, TableDefinition, added, compare

TRANSIENT = (404, 429)


class Files:
    """The few file operations needed, by Hadoop's file systems, so any store that Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


#: Where the marks of commits are, beside the tables.
UNITS = "_units"


@dataclass
class Store:
    spark: SparkSession
    root: str
    max_records_per_file: int = 500_000
    files: Files = field(init=False)

    def __post_init__(self) -> None:
        self.files = Files(self.spark)

    def create(self, table: TableDefinition) -> None:
        """Creates a table; one that is there stays as it is."""
        if not self.files.exists(f"{self.root}/{table.name}/schema.json"):
            self.files.write(f"{self.root}/{table.name}/schema.json", table.schema().json())

    def schema(self, name: str) -> T.StructType:
        if not self.files.exists(f"{self.root}/{name}/schema.json"):
            raise TableNotFound(name)
        return T.StructType.fromJson(json.loads(self.files.read(f"{self.root}/{name}/schema.json")))

    def sync(self, table: TableDefinition) -> Difference:
        """Adds what a table lacks; refuses a changed type. Returns what was found."""
        found = self.schema(table.name)
        difference = compare(table.schema(), found)
        if difference.missing or difference.mismatched:
            self.files.write(f"{self.root}/{table.name}/schema.json", added(table.schema(), found).json())
        return difference

    def check(self, tables: Sequence[TableDefinition]) -> DataFrame:
        """``table, path, problem`` for all that is missing or different; no rows if all is well."""
        rows = []
        for t in tables:
            try:
                d = compare(t.schema(), self.schema(t.name))
            except TableNotFound:
                rows.append((t.name, None, "the table is missing"))
                continue
            rows += [(t.name, p, f"missing, {k} is expected") for p, k in d.missing.items()]
            rows += [(t.name, p, f"is {b}, {a} is expected") for p, (a, b) in d.mismatched.items()]
        return self.spark.createDataFrame(rows, "table string, path string, problem string")

    def commits(self, name: str) -> list[str]:
        """The commits of a table that count: those whose one mark, which all their tables share, is there."""
        found = self.files.names(f"{self.root}/{name}/commits")
        marked = set(self.files.names(f"{self.root}/{UNITS}"))
        return [c for c in found if c in marked]

    def read(self, name: str, commits: Sequence[str] | None = None) -> DataFrame:
        """The current rows: of each id the latest one. ``commits`` pins a snapshot.

        Filters on any column reach the files: which commit has the latest row of an id is found from ids and commits alone, and the rows
        that pass are held against it. Rows without an id all stay.
        """
        schema = self.schema(name)
        commits = self.commits(name) if commits is None else list(commits)
        if not commits:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_commit", T.StringType())])).parquet(*[f"{self.root}/{name}/commits/{c}/data" for c in commits])
        if len(commits) == 1:
            return rows.drop("_commit")
        last = rows.where("id IS NOT NULL").groupBy("id").agg(F.max("_commit").alias("_commit"))
        known = rows.where("id IS NOT NULL").join(last, ["id", "_commit"], "left_semi").select(*rows.columns)
        return known.unionByName(rows.where("id IS NULL")).drop("_commit")

    def stage(self, rows: DataFrame, name: str, commit: str) -> None:
        schema = self.schema(name)
        have = set(rows.columns)
        typed = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
        rows.select(*typed, F.lit(commit).alias("_commit")).write.option("maxRecordsPerFile", self.max_records_per_file).mode("overwrite").parquet(f"{self.root}/{name}/commits/{commit}/data")

    def publish(self, commit: str) -> None:
        """Makes a commit count in every table it was staged in, by writing one file: there is no moment at which some have it and some not."""
        self.files.write(f"{self.root}/{UNITS}/{commit}", "")

    def discard(self, name: str, commit: str) -> None:
        self.files.remove(f"{self.root}/{name}/commits/{commit}")

    def upsert(self, records: DataFrame, routes: Sequence[str], commit: str) -> None:
        """Writes routed records (column ``route``) as one commit over their tables: of rows with one id the last by seq or time stays.

        Every record needs an id and every table has to be there. Writing the same commit again replaces it, so a retried batch
        leaves what one would have left.
        """
        for name in routes:
            self.schema(name)
        if not records.where("id IS NULL").isEmpty():
            raise InvalidRecord("a record without an id can't be written in bulk")
        order = [F.col(c).desc() for c in ("seq", "writtenAt") if c in records.columns] or [F.lit(1)]
        once = records.withColumn("_rank", F.row_number().over(Window.partitionBy("route", "id").orderBy(*order))).where("_rank = 1").drop("_rank")
        for name in routes:
            self.stage(once.where(F.col("route") == name), name, commit)
        self.publish(commit)


def bulk_outcome(items: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected items: a response belongs to the item of its position and id. 404, 429 and 5xx may be tried again."""
    both = items.join(responses.select("position", "id", "status", "reason"), ["position", "id"], "left")
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    transient = F.col("status").isin(*TRANSIENT) | (F.col("status") >= 500)
    rejected = both.where(~F.coalesce(ok, F.lit(False))).withColumn("transient", F.coalesce(transient, F.lit(False))).withColumn("reason", F.coalesce("reason", F.lit("no answer for the item")))
    return both.where(F.coalesce(ok, F.lit(False))).drop("status", "reason"), rejected


def error_kind(status: int) -> str:
    """Names the kind of a failure by its status."""
    return "TableNotFound" if status == 404 else "Unavailable" if status == 429 or status >= 500 else "InvalidQuery" if status == 400 else "Rejected"


@dataclass
class UnitOfWork:
    """All or nothing over several tables: writes are staged and published together, or not at all.

    The first reason to spoil it counts. Outbox rows are staged in the same unit, so a message exists if and only if its record does.
    """

    store: Store
    staged: list[tuple[str, str]] = field(default_factory=list)
    reason: str | None = None
    open: bool = True
    commit: str = field(default_factory=lambda: f"{time.time_ns():020d}-{uuid.uuid4().hex}")  # commits count in the order of their names

    def write(self, records: DataFrame, name: str, outbox: str | None = None) -> None:
        if not self.open:
            raise TransactionSpoilt("the unit of work is over")
        for table in (name, outbox) if outbox else (name,):
            if (table, self.commit) in self.staged:
                raise TransactionSpoilt(f"{table} has been written in this unit of work")
            self.store.stage(records, table, self.commit)
            self.staged.append((table, self.commit))

    def spoil(self, reason: str) -> None:
        if self.open and self.reason is None:
            self.reason = reason

    def write_now(self) -> None:
        """The immediate road is refused inside a unit of work, and spoils it."""
        self.spoil("a record was to be written at once inside a unit of work")
        raise TransactionSpoilt(self.reason or "")

    def __enter__(self) -> UnitOfWork:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, _: object) -> None:
        if error is not None:
            self.spoil(str(error) or type(error).__name__)
        self.open = False
        if self.reason:
            for name, commit in self.staged:
                self.store.discard(name, commit)
        elif self.staged:
            self.store.publish(self.commit)
        if self.reason and error is None:
            raise TransactionSpoilt(self.reason)


@dataclass
class Collector:
    """A sink that keeps what it is given, with the assertions tests want."""

    rows: list[dict] = field(default_factory=list)

    def write(self, records: DataFrame) -> None:
        self.rows += [r.asDict(recursive=True) for r in records.collect()]

    def of(self, **wanted: object) -> list[dict]:
        return [r for r in self.rows if all(r.get(k) == v for k, v in wanted.items())]

    def assert_written(self, count: int | None = None, **wanted: object) -> list[dict]:
        found = self.of(**wanted)
        assert found if count is None else len(found) == count, f"{len(found)} records fit {wanted}"
        return found

    def assert_nothing(self, **wanted: object) -> None:
        assert not self.of(**wanted), f"records fit {wanted}"


def legacy_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of any age: every base field as text, changes and the rest as they are."""
    schema = "_id string, id string, objectType string, objectId string, event string, loggedAt string, writtenAt string, source string, changes string, warehouseId long, note string"
    return spark.read.schema(schema).json(path, multiLine=True)


def routes_of(routing: Mapping[str, str], default: str) -> list[str]:
    return list(dict.fromkeys([default, *routing.values()]))
