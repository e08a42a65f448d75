"""Ordered folds: what order alone decides, read row by row from sorted partitions and never held as a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result that go back to Spark together.
ROWS_AT_ONCE = 4096


def fold_ordered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[tuple, Iterator[dict[str, Any]]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold(key, rows)`` for the rows of every key, in order; it yields tuples of ``schema``.

    Partitions are sorted by Spark, which spills, and a fold sees one row at a time: a worker holds one Arrow
    batch and what the fold itself remembers, however many rows a key has.
    """
    names, arrow = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (dict(zip(names, values)) for batch in batches for values in zip(*[c.to_pylist() for c in batch.columns]))
        out: list[dict[str, Any]] = []
        for key, group in groupby(each, key=lambda r: tuple(r[k] for k in keys)):
            for found in fold(key, group):
                out.append(dict(zip(arrow.names, found)))
                if len(out) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
