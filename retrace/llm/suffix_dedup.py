"""Removal of byte strings that occur twice, and passages of words that another text has too: suffix arrays by linear grouping over minimizer buckets."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.common import Scratch, partitions_for
from retrace.llm.jaccard_join import batches_of
from retrace.llm.suffix_array import suffix_array
from retrace.llm.windows import minimizer_runs
from retrace.llm.words import BASE, byte_codes, mixed, word_hashes

#: Runs a worker gathers before it merges equal ones, contexts of one suffix array at most, units at which small buckets stop sharing one.
RUNS_AT_ONCE, BLOCK, UNITS_TOGETHER = 300_000, 512, 12_000
#: From so many distinct runs in one deal, a key is known to be shared, and its runs are dealt out one by one.
HOT = 16
#: Parts into which the places of a minimizer in a window are cut, to see which runs of a bucket may share a window at all.
SLICES = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RANGES = "array<struct<begin:int,end:int>>"
RANGES_ARROW = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


class Unit(NamedTuple):
    """What windows are made of: bytes, or words by their hashes, and how many of them a window has."""

    words: bool
    length: int

    @property
    def width(self) -> int:
        """Bytes of a unit where it is handed on."""
        return 8 if self.words else 1

    @property
    def gram(self) -> int:
        """Units of a minimizer: the largest power of two up to two thirds of the window."""
        return 1 << max(0, (2 * self.length // 3).bit_length() - 1)

    def codes(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(part) if self.words else byte_codes(part)

    def data(self, part: list[bytes], codes: np.ndarray) -> memoryview:
        """All texts as they are cut into windows and compared."""
        return memoryview(codes.tobytes() if self.words else b"".join(part))


def units_of(length: int, passage: int | None) -> list[Unit]:
    return [Unit(False, length)] + [Unit(True, passage)] * (passage is not None)


def _runs(part: list[bytes], unit: Unit) -> tuple[np.ndarray, ...]:
    """Runs of a part of texts: text, first start, starts, offset of the minimizer, key, and the two halves of a digest of the run's units."""
    codes, sizes = unit.codes(part)
    own, start, n, off, key = minimizer_runs(codes, sizes, unit.length, unit.gram)
    view, width, digest = unit.data(part, codes), unit.width, xxhash.xxh3_128_digest
    begin = ((np.cumsum(sizes) - sizes)[own] + start) * width
    end = begin + (n + unit.length - 1) * width
    both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
    return own, start, n, off, key.view(np.int64), both[:, 0], both[:, 1]


def remove_repeats(docs: DataFrame, length: int = 400, passage: int | None = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, passages``: each text without the bytes of strings that occur twice.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, the
    same text included; strings are judged on the input. spans are the maximal removed runs, kept the
    remaining bytes (binary). passages are the runs of words covered by ``passage`` words (A-Z lower-cased,
    whatever space stands between them) that another row has as well; they are reported and not removed. None asks for no
    passages. Null text: empty. Rows are named by their place in ``docs``, which has to be a stored table; repeated
    rows are rows of their own. An empty table gives an empty result.

    Every window start, of bytes and of words, falls into one run by the minimizer of its window, so equal windows meet under one
    key, with just the units of their run and the window length around them. Runs of equal units are
    merged where they are read and again when they meet, so a third of all rows that are copies become one.
    A key with one distinct run is settled by who has it. Otherwise the distinct runs, joined, are sorted by the
    suffix array of linear grouping, in which equal windows are neighbours; runs that agree with no other of their bucket
    around the minimizer for nearly a window are left out before. Buckets of more than BLOCK
    runs are sorted in parts; each part hands on its windows, and those are counted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    units = units_of(length, passage)
    source = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    parts = partitions_for(docs)

    dealt = scratch.keep(_dealt_runs(source, units, parts), "dealt")
    shared = scratch.keep(_shared_runs(dealt), "shared")
    scratch.drop("dealt")
    several = shared.where("kinds > 1")
    sorted_ = scratch.keep(_sorted_buckets(source, several, units, parts), "sorted")
    found = shared.where("kinds = 1").select("c1", "c2", F.array(F.struct(F.lit(0).alias("begin"), F.col("n").alias("end"))).cast(RANGES).alias("ranges"))
    found = found.unionByName(sorted_.where("size(ranges) > 0").select("c1", "c2", "ranges"))
    if not shared.where(F.col("kinds") > BLOCK).isEmpty():
        windows = sorted_.select(F.explode("windows").alias("w"), "c1", "c2").select(F.struct("w.w1", "w.w2").alias("at"), "w.lo", "w.hi", "w.index", "c1", "c2")
        twice = windows.groupBy("at.w1", "at.w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(F.struct("w1", "w2").alias("at"))
        more = windows.where("lo = hi").join(twice, "at").select("c1", "c2", F.array(F.struct(F.col("index").alias("begin"), (F.col("index") + 1).alias("end"))).cast(RANGES).alias("ranges"))
        found = found.unionByName(more)
    found = scratch.keep(found.select(F.struct("c1", "c2").alias("at"), "ranges"), "found")
    places = _places(source, units).select(F.struct("c1", "c2").alias("at"), "tie", "words", "starts").join(found, "at")
    every = lambda of: F.flatten(F.transform("starts", lambda s: F.transform("ranges", lambda r: s + of(r))))
    places = places.select("tie", "words", every(lambda r: r["begin"]).alias("begin"), every(lambda r: r["end"] - 1 + F.when(F.col("words"), F.lit(passage or 0)).otherwise(F.lit(length))).alias("end"))
    both = [F.flatten(F.collect_list(F.when(F.col("words") == words, F.col(side)))).alias(f"{side}_{words}") for words in (False, True) for side in ("begin", "end")]
    spans = scratch.keep(places.groupBy("tie").agg(*both), "spans")
    scratch.drop("shared", "sorted", "found")
    return source.join(spans, "tie", "left").select("doc_id", "text", *[f"{side}_{words}" for words in (False, True) for side in ("begin", "end")]).mapInArrow(_cut, f"doc_id {id_type}, n_bytes long, n_removed long, spans {RANGES}, kept binary, passages {RANGES}")


def _dealt_runs(source: DataFrame, units: list[Unit], parts: int) -> DataFrame:
    """Runs of keys that several have: ``words, key, c1, c2, n, off, lo, hi, tie, start``.

    lo and hi are the least and the greatest owner of a run: for bytes an owner is a place, for words a text.
    A run goes to the partition of its key, where keys with one owner are dropped. A key with HOT distinct runs
    in one deal is known to be shared: each of its runs goes where its digest says, and the key's
    partition only gets word of it. So no key brings more than HOT runs of a deal together.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Unit, list[tuple]] = {u: [] for u in units}
        n = 0
        for batch in batches:
            for at, part in batches_of(batch.column(1).to_pylist()):
                ties = batch.column(0).slice(at, len(part)).to_numpy()
                for unit in units:
                    own, start, many, off, key, c1, c2 = _runs(part, unit)
                    owner = ties[own] if unit.words else mixed(ties[own].astype(np.uint64) * np.uint64(BASE) + start.astype(np.uint64)).view(np.int64)
                    held[unit].append((key, c1, c2, many, off, owner, ties[own], start))
                    n += len(key)
                if n >= RUNS_AT_ONCE:
                    yield from (merged(x, u) for u, x in held.items())
                    held, n = {u: [] for u in units}, 0
        if n:
            yield from (merged(x, u) for u, x in held.items())

    def merged(held: list[tuple], unit: Unit) -> pa.RecordBatch:
        key, c1, c2, n, off, owner, tie, start = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((c2, c1, key))
        first = np.ones(len(order), bool)
        first[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1]) | (key[order][1:] != key[order][:-1])
        first = np.flatnonzero(first)
        at = order[first]
        lo, hi = (np.minimum.reduceat(owner[order], first), np.maximum.reduceat(owner[order], first)) if len(first) else (owner, owner)
        keys = key[at]
        bound = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), keys[1:] != keys[:-1])))
        size = np.diff(np.append(bound, len(at)))
        hot = np.repeat(size >= HOT, size)
        word = keys[bound[size >= HOT]]  # of hot keys, to their partitions
        none = np.zeros(len(word), np.int64)
        columns = [np.where(hot, c1[at], keys), keys, c1[at], c2[at], n[at], off[at], lo, hi, tie[at], start[at]]
        extra = [word, word, none, none, none, none, none + LEAST, none + MOST, none, none]
        columns = [np.concatenate(x) for x in zip(columns, extra)]
        whole = len(columns[0])
        kinds = (np.int64,) * 4 + (np.int32,) * 2 + (np.int64,) * 3 + (np.int32,)
        arrays = [pa.array(np.full(whole, unit.words)), pa.array(np.concatenate((hot, np.zeros(len(word), bool))))] + [pa.array(x.astype(k)) for x, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    names = ["words", "hot", "deal", "key", "c1", "c2", "n", "off", "lo", "hi", "tie", "start"]
    runs = source.select("tie", "text").mapInArrow(collect, "words boolean, hot boolean, deal long, key long, c1 long, c2 long, n int, off int, lo long, hi long, tie long, start int")
    # dealt by one column alone, so that the runs of a key and who has them need no further exchange
    runs = runs.repartition(parts, "deal").groupBy("deal", "hot", "words", "key", "c1", "c2", "n", "off").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("tie", "start")).alias("at"))
    own = Window.partitionBy("deal")
    runs = runs.withColumn("least", F.min("lo").over(own)).withColumn("most", F.max("hi").over(own)).where("(hot OR least <> most) AND n > 0")
    return runs.select("words", "key", "c1", "c2", "n", "off", "lo", "hi", "at.tie", "at.start")


def _shared_runs(dealt: DataFrame) -> DataFrame:
    """The distinct runs of ``dealt`` with kinds, how many their key has; keys whose one run has one owner go."""
    runs = dealt.groupBy("words", "key", "c1", "c2", "n", "off").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("tie", "start")).alias("at"))
    kinds = runs.groupBy("key").agg(F.count("*").alias("kinds"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select(F.struct("key").alias("of"), "kinds")
    return runs.withColumn("of", F.struct("key")).join(kinds, "of").select("words", "key", "c1", "c2", "n", "off", "lo", "hi", "kinds", "at.tie", "at.start")


def _sorted_buckets(source: DataFrame, several: DataFrame, units: list[Unit], parts: int) -> DataFrame:
    """``c1, c2, ranges, windows`` of the runs of keys with several: ranges of starts whose windows two owners have in the bucket's part.

    windows is set for buckets in several parts: of windows that one owner has there each place, of others one, with
    both owners.
    """
    blocks = F.ceil(F.col("kinds") / BLOCK).cast("int")
    wanted = several.withColumn("blocks", blocks).withColumn("block", F.pmod(F.col("c1"), F.col("blocks")).cast("int"))
    wanted = wanted.groupBy("tie").agg(F.collect_list(F.struct("words", "key", "block", "blocks", "c1", "c2", "n", "off", "lo", "hi", "start")).alias("runs"))
    texts = source.select("tie", "text").join(wanted, "tie").select("text", "runs")
    by = {u.words: u for u in units}
    fields = [("words", pa.bool_()), ("key", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("data", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = [text.encode("utf-8", "replace")]
                views = {u.words: u.data(part, u.codes(part)[0] if u.words else None) for u in units if any(r["words"] == u.words for r in runs)}
                for r in runs:
                    unit = by[r["words"]]
                    out.append((*[r[n] for n, _ in fields[:-1]], bytes(views[unit.words][r["start"] * unit.width : (r["start"] + r["n"] + unit.length - 1) * unit.width])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # many small lists and no cycles: the collector would only look through them again and again
        gc.disable()
        try:
            yield from in_order(batches)
        finally:
            gc.enable()

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (Run(*row) for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for words, rows in groupby(each, key=lambda r: r.words):
            unit, held, size = by[words], [], 0
            for _, group in groupby(rows, key=lambda r: (r.key, r.block)):
                own = list(group)
                held.append(own)
                size += sum(len(r.data) for r in own) // unit.width
                if size >= UNITS_TOGETHER:
                    yield judged(held, unit)
                    held, size = [], 0
            if held:
                yield judged(held, unit)

    def judged(buckets: list[list[Run]], unit: Unit) -> pa.RecordBatch:
        rows = [r for own in buckets for r in own]
        stays = [i for own in buckets for i in (np.ones(len(own), bool) if own[0].blocks > 1 else may_share(own, unit)).tolist()]
        twice, windows = [np.full(r.n, r.lo != r.hi) for r in rows], [[] if r.blocks > 1 else None for r in rows]
        use = [i for i, s in enumerate(stays) if s]
        for members in equal_windows([rows[i] for i in use], unit):
            members = [(use[i], s) for i, s in members]
            lo, hi = min(rows[i].lo for i, _ in members), max(rows[i].hi for i, _ in members)
            if lo != hi:
                for i, s in members:
                    twice[i][s] = True
            if windows[members[0][0]] is not None:
                for i, s in members[:1] if lo != hi else members:
                    w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(rows[i].data[s * unit.width : (s + unit.length) * unit.width]), np.int64).tolist()
                    windows[i].append({"w1": w1, "w2": w2, "lo": lo, "hi": hi, "index": s})
        ranges = [[{"begin": int(a), "end": int(b)} for a, b in np.flatnonzero(np.diff(np.concatenate(([0], t.astype(np.int8), [0])))).reshape(-1, 2)] for t in twice]
        types = (pa.int64(), pa.int64(), RANGES_ARROW, pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("index", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([r.c1 for r in rows], [r.c2 for r in rows], ranges, windows), types)], ["c1", "c2", "ranges", "windows"])

    runs = texts.mapInArrow(cut, "words boolean, key long, block int, blocks int, c1 long, c2 long, n int, off int, lo long, hi long, data binary")
    runs = runs.repartition(parts, "key", "block").sortWithinPartitions("words", "key", "block")
    return runs.mapInArrow(sort, f"c1 long, c2 long, ranges {RANGES}, windows array<struct<w1:long,w2:long,lo:long,hi:long,index:int>>")


class Run(NamedTuple):
    words: bool
    key: int
    block: int
    blocks: int
    c1: int
    c2: int
    n: int
    off: int
    lo: int
    hi: int
    data: bytes


def may_share(bucket: list[Run], unit: Unit) -> np.ndarray:
    """Which runs of a bucket may have a window in common with another one.

    All runs of a bucket have its minimizer, ``off`` units from their first start. A window that has x units
    before the minimizer holds the string from a units before it to slack - b units after it for
    a <= x <= b. So runs with an equal window agree in such a string for the slice [a, b] of x.
    """
    slack, width = unit.length - unit.gram, unit.width
    edges = [slack * k // SLICES + (k > 0) for k in range(SLICES)] + [slack + 1]
    met: dict[tuple[int, int], int] = {}
    stays = np.zeros(len(bucket), bool)
    for i, r in enumerate(bucket):
        for k in range(SLICES):
            a, b = edges[k], edges[k + 1] - 1
            if max(a, r.off - r.n + 1) <= min(b, r.off):
                at = (k, xxhash.xxh3_64_intdigest(r.data[(r.off - a) * width : (r.off + unit.length - b) * width]))
                other = met.setdefault(at, i)
                if other != i:
                    stays[i] = stays[other] = True
    return stays


def equal_windows(runs: list[Run], unit: Unit) -> Iterator[list[tuple[int, int]]]:
    """The windows of all runs, equal ones together: run and start of each.

    The runs are joined with a lowest symbol between them; in the suffix array equal windows stand next to each other. Every window
    of a run holds the run's minimizer whole, so the minimizer stands as one symbol, its own for each content, and windows are shorter by the rest of it.
    """
    if not runs:
        return
    width, gram = unit.width, unit.gram
    sides = [(r.data[: r.off * width], r.data[(r.off + gram) * width :]) for r in runs]
    if unit.words:
        every = np.frombuffer(b"".join(x for side in sides for x in side), np.uint64)
        ranks = iter(np.split((np.unique(every, return_inverse=True)[1] + 1), np.cumsum([len(x) // 8 for side in sides for x in side])[:-1]))
        sides = [(next(ranks).tolist(), next(ranks).tolist()) for _ in runs]
        above = len(every) + 1
    else:
        sides = [([b + 1 for b in x], [b + 1 for b in y]) for x, y in sides]
        above = 257
    grams: dict[bytes, int] = {}
    joined: list[int] = []
    own, bounds = [], []
    for i, (r, (before, after)) in enumerate(zip(runs, sides)):
        bounds.append(len(joined))
        joined += before
        joined.append(above + grams.setdefault(r.data[r.off * width : (r.off + gram) * width], len(grams)))
        joined += after
        joined.append(0)
        own += [i] * r.n + [-1] * (len(before) + len(after) + 2 - r.n)
    last, members = None, []
    for at in suffix_array(joined):
        i = own[at]
        if i < 0:
            continue
        s = at - bounds[i]
        window = runs[i].data[s * width : (s + unit.length) * width]
        if window != last and members:
            yield members
            members = []
        members.append((i, s))
        last = window
    if members:
        yield members


def _places(source: DataFrame, units: list[Unit]) -> DataFrame:
    """``tie, words, c1, c2, starts``: where the runs of each text begin, equal runs of a text together."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in batches_of(batch.column(1).to_pylist()):
                for unit in units:
                    own, start, _, _, _, c1, c2 = _runs(part, unit)
                    if not len(own):
                        continue
                    order = np.lexsort((start, c2, c1, own))
                    o, d1, d2, s = own[order], c1[order], c2[order], start[order]
                    first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(o)).astype(np.int32)), pa.array(s.astype(np.int32)))
                    ties = batch.column(0).slice(at, len(part)).to_numpy()[o[first]]
                    yield pa.RecordBatch.from_arrays([pa.array(ties), pa.array(np.full(len(first), unit.words)), pa.array(d1[first]), pa.array(d2[first]), lists], ["tie", "words", "c1", "c2", "starts"])

    return source.select("tie", "text").mapInArrow(find, "tie long, words boolean, c1 long, c2 long, starts array<int>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, text, and where repeated strings and passages begin and end, to the columns of the result."""
    for batch in batches:
        texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        found = [_lists(batch.column(c)) for c in range(2, 6)]
        kept, removed, spans, passages = [], [], [], []
        for i, data in enumerate(texts):
            begin, end, word_begin, word_end = (x[i] for x in found)
            if len(begin):
                gone = _covered(len(data), begin, end)
                removed.append(int(gone.sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                spans.append(_edges(gone))
            else:
                removed.append(0)
                kept.append(data)
                spans.append(NOTHING)
            passages.append(_edges(_covered(int(word_end.max()), word_begin, word_end)) if len(word_begin) else NOTHING)
        arrays = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), _ranges(spans), pa.array(kept, pa.binary()), _ranges(passages)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "passages"])


NOTHING = np.zeros((0, 2), np.int32)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as arrays, a null one as an empty one."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)  # without what stands behind nulls
    return np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _covered(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` units lie in one of the spans."""
    return np.cumsum(np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] > 0


def _edges(marks: np.ndarray) -> np.ndarray:
    """Begin and end of each run of marked units, a row per run."""
    return np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))).astype(np.int32).reshape(-1, 2)


def _ranges(rows: list[np.ndarray]) -> pa.Array:
    """A list of ranges for each row."""
    flat = np.concatenate([NOTHING, *rows])
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0]), pa.int32()), pa.array(np.ascontiguousarray(flat[:, 1]), pa.int32())], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)
