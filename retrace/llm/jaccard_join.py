"""N-gram Jaccard join by parity sketches: pigeonhole keys per size band, Hamming bound, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.llm.common import Scratch, partitions_for
from retrace.llm.components import connected_components
from retrace.llm.words import mixed, shingle_sets

#: Text bytes and documents that are hashed at once (so few that their arrays stay in a core's cache), keys that a worker gathers before it deals them out.
BYTES_AT_ONCE, DOCS_AT_ONCE, KEYS_AT_ONCE = 250_000, 2048, 400_000
#: Members of a bucket that one worker task compares at once; larger buckets are split into pairs of blocks.
BLOCK = 2048
#: From so many members in one deal, a key is known to be shared and only one of them goes to be counted.
HOT = 64
#: Shuffled orders that choose the members to which families are tied first.
HUBS = 8
#: Places of a sketch, of the form that goes along with keys, and of the one by which most pairs are told apart first.
BITS, FOLDED, COARSE = 1 << 15, 1 << 12, 1 << 10


#: A need is kept in seven bits; a set that needs more keys than this is held to this many.
MOST_NEEDED = 127


class Bands:
    """Size bands and how many blocks a sketch has in each.

    A band is [e, e * 100 // percent], so two sets that may link are in the same band or in neighbours.
    Join group i holds bands i and i + 1. Two linked sets in it differ in at most ``most[i]`` elements,
    and a differing element changes one block, so of ``blocks[i]`` = most + margin blocks at least margin
    are equal. The margin grows with the size, so that long sets which share a passage only have far
    fewer equal blocks than it asks for.
    """

    def __init__(self, percent: int):
        self.percent, self.starts, self.most, self.margin = percent, [1], [], []
        while self.starts[-1] < 1 << 40:
            self.starts.append(self.starts[-1] * 100 // percent + 1)
        for i in range(len(self.starts) - 2):
            self.most.append((100 - percent) * (self.starts[i + 1] - 1 + self.starts[i + 2] - 1) // (100 + percent))
            self.margin.append(1 if self.most[-1] == 0 else 2 if self.most[-1] < 10 else max(4, self.most[-1] // 8))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.starts), sizes, side="right") - 1


def batches_of(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Cuts a batch of texts into parts of bounded bytes; a longer text is a part by itself."""
    part: list[bytes] = []
    at = size = 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "replace")
        if part and (size + len(data) > BYTES_AT_ONCE or len(part) >= DOCS_AT_ONCE):
            yield at, part
            part, at, size = [], i, 0
        part.append(data)
        size += len(data)
    if part:
        yield at, part


def nodes_of(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal sets have equal names; 0 for an empty one."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        sums = np.add.reduceat(mixed(codes + np.uint64(0x51ED27)), starts[full])
        out[full] = mixed(sums ^ mixed(counts[full].astype(np.uint64)))
    return out


def block_keys(codes: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets: key, index of the set, and flags: 1 if the set is of the upper band of the group, and twice its need.

    The sketch of a set has a bit for each (hashed) place, flipped by every element there. Its blocks are
    cut by the leading bits of the elements, which are sorted, so each block is a run; the key of a block is
    the XOR of a hash of its places, which is a linear hash of the bits. At least ``margin`` blocks of
    two linked sets are equal, so a set shares that many keys less its empty blocks with each partner:
    its need. Where all equal blocks may be empty (as many as ``margin`` are, in both sets then), a set gives its
    least elements as keys instead, as many as may be missing in a partner and one more: of these one is shared.
    """
    sets = np.flatnonzero(counts)
    own = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    band = bands.of(counts)
    keys, owners, flags = [], [], []
    for upper in (0, 1):
        group = band - upper
        use = sets[group[sets] >= 0]
        if not len(use):
            continue
        blocks = np.zeros(len(counts), np.int64)
        margin = np.zeros(len(counts), np.int64)
        for g in np.unique(group[use]).tolist():
            blocks[group == g], margin[group == g] = bands.most[g] + bands.margin[g], bands.margin[g]
        inside = group[own] >= 0
        o, c = own[inside], codes[inside]
        place = (c >> np.uint64(12)) * blocks[o].astype(np.uint64) >> np.uint64(40)
        first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (place[1:] != place[:-1]))))
        value = np.bitwise_xor.reduceat(mixed(c ^ (group[o].astype(np.uint64) << np.uint64(53))), first)
        o, place = o[first], place[first]
        filled = np.bincount(o, minlength=len(counts))
        need = np.clip(margin - (blocks - filled), 1, MOST_NEEDED)
        keys.append(mixed(value ^ mixed(group[o].astype(np.uint64) << np.uint64(32) | place)))
        owners.append(o)
        flags.append((upper | need[o] << 1).astype(np.uint8))
        for i in use[(blocks - filled)[use] >= margin[use]].tolist():
            n = int(counts[i])
            least = codes[begins[i] : begins[i] + n + bands.percent * -n // 100 + 1]
            keys.append(mixed(mixed(least) ^ np.uint64(group[i]) << np.uint64(53)))
            owners.append(np.full(len(least), i))
            flags.append(np.full(len(least), upper | 2, np.uint8))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(flags)


def sketch(codes: np.ndarray) -> bytes:
    """The parity sketch of a set: BITS places, each flipped by every element there.

    Kept as the list of the places that are set, or as bits where these are shorter.
    """
    odd = odd_places((codes & np.uint64(BITS - 1)).astype(np.uint16))
    if 16 * len(odd) < BITS:
        return b"S" + odd.tobytes()
    flips = np.zeros(BITS, np.uint8)
    flips[odd] = 1
    return b"D" + np.packbits(flips, bitorder="little").tobytes()


def odd_places(places: np.ndarray) -> np.ndarray:
    """Places that come up an odd number of times, in order."""
    places = np.sort(places)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(places)), bool), places[1:] != places[:-1])))
    return places[first][np.diff(np.append(first, len(places))) & 1 == 1]


def thin(data: bytes) -> bytes:
    """A sketch as it goes along with every key: as it is if it is short, else folded to FOLDED bits."""
    if data[:1] == b"S" and len(data) <= FOLDED // 8 + 1:
        return data
    flips = np.bincount(set_places(data) & np.uint16(FOLDED - 1), minlength=FOLDED) & 1
    return b"F" + np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def set_places(data: bytes) -> np.ndarray:
    """The places that are set in a sketch, in order."""
    if data[:1] == b"S":
        return np.frombuffer(data, np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little")).astype(np.uint16)


def coarse(data: bytes) -> np.ndarray:
    """A sketch folded to COARSE bits: places are the trailing bits of an element, so parities add up."""
    flips = np.bincount(set_places(data) & np.uint16(COARSE - 1), minlength=COARSE) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two sketches by their set places."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return len(both) - 2 * int((both[1:] == both[:-1]).sum())


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, tie``: documents linked by 100 * intersection >= percent * union of their shingles.

    1. Every text becomes its set of shingles (``words`` words, A-Z lower-cased) and a 64-bit name of the
       set. Copies share a name and are one node from here on.
    2. Nodes give their block keys. A node stays a candidate if it has as many keys in common with others
       as it must have with each node it links with; keys with two or more such nodes tie their
       members to one of them, which is linear in the size of a group.
    3. Tied pairs are cut by sizes and the Hamming distance of their sketches, a lower bound of the
       symmetric difference, and verified on the sets. Verified links give components.
    4. Keys whose members are still in several components are compared inside the worker, sketch against
       sketch, and every pair of different components within the bound that step 3 has not seen is
       verified too. So no link between different texts is lost, and none inside a component is repeated.

    Texts without words, or null, are linked with nothing and are their own component. component_id is
    the smallest doc_id of the component; null ids count as above all. kept marks one row of each component,
    of that id and the first of its rows; tie is a row's place in the table. Rows that repeat a text link by it. ``docs`` has to be a stored table: rows are named by their place in it, in two reads. Shingles
    are 52-bit hashes; names and keys 64-bit ones, and what they suggest is verified.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    bands = Bands(percent)
    source = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("tie"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in batches_of(batch.column(2).to_pylist()):
                codes, counts = shingle_sets(part, words)
                cut = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(nodes_of(codes, counts).view(np.int64)), pa.array(counts.astype(np.int64))], ["doc_id", "tie", "node", "n"])

    named = scratch.keep(source.mapInArrow(name_sets, f"doc_id {id_type}, tie long, node long, n long"), "named")
    dealt = scratch.keep(_shared_keys(source.select("text"), words, bands), "dealt")
    shared = scratch.keep(_enough(dealt), "shared")
    scratch.drop("dealt")
    members = scratch.keep(_candidate_sets(source, named, shared, words), "members")
    pairs = shared.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    links = scratch.keep(_verified(pairs, members, percent), "links")
    roots = connected_components(links, scratch, "first")
    across = scratch.keep(_across(shared, roots, members, percent), "across")
    more = scratch.keep(_verified(across, members, percent), "more")
    roots = connected_components(links.unionByName(more), scratch, "second")
    scratch.drop("shared", "links", "more", "across", "members")

    full = named.where("n > 0").select("doc_id", "tie", "n", F.struct("node").alias("at"))
    full = full.join(roots.select(F.struct("node").alias("at"), "root"), "at", "left").select("doc_id", "tie", "n", F.struct(F.coalesce("root", "at.node").alias("root")).alias("at"))
    full = scratch.keep(full, "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    least = full.groupBy("at.root").agg(first.alias("first")).select(F.struct("root").alias("at"), "first")
    out = full.join(least, "at").select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("tie") == F.col("first.tie")).alias("kept"), "tie")
    return out.unionByName(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "tie"))


def _shared_keys(texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    """``key, node, upper, need`` of every key that two nodes have, one of them of the group's lower band; need is the node's in this group.

    Workers deal packets of keys out to bins instead of rows: a packet holds, for one bin, the keys and the
    nodes that have them. A bin is read alone, sorted by key in memory; its size follows from the
    number of bins, which grows with the input.
    """
    parts = partitions_for(texts)
    bins = 4 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for _, part in batches_of(batch.column(0).to_pylist()):
                codes, counts = shingle_sets(part, words)
                keys, own, flags = block_keys(codes, counts, bands)
                held.append((keys, nodes_of(codes, counts)[own], flags))
                n += len(keys)
                if n >= KEYS_AT_ONCE:
                    yield packets(held)
                    held, n = [], 0
        if n:
            yield packets(held)

    def packets(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, nodes, flags = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((nodes, keys))
        keys, nodes, flags = keys[order], nodes[order], flags[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
        keys, nodes, flags = keys[new], nodes[new], flags[new]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        many = np.repeat(size >= HOT, size)
        lead = np.zeros(len(keys), bool)
        lead[first] = True
        out_bin, out_data = [], []
        # hot keys: members go along as they are, to any bin; the first goes to be counted
        for at in range(0, int(many.sum()), 1 << 16):
            hot = np.flatnonzero(many)[at : at + (1 << 16)]
            out_bin.append(int(keys[hot[0]] % np.uint64(bins)))
            out_data.append(b"H" + keys[hot].tobytes() + nodes[hot].tobytes() + flags[hot].tobytes())
        stay = ~many | lead
        keys, nodes, flags, many = keys[stay], nodes[stay], flags[stay], many[stay]
        # a hot key counts as one of the lower band: its members are shared already
        flags = np.where(many, flags & 0xFE, flags).astype(np.uint8)
        bin_of = (keys % np.uint64(bins)).astype(np.int64)
        order = np.argsort(bin_of, kind="stable")
        bounds = np.searchsorted(bin_of[order], np.arange(bins + 1))
        for b in range(bins):
            at = order[bounds[b] : bounds[b + 1]]
            if len(at):
                names, index = np.unique(nodes[at], return_inverse=True)
                out_bin.append(b)
                out_data.append(b"K" + np.array([len(at), len(names)], np.uint64).tobytes() + keys[at].tobytes() + names.tobytes() + index.astype(np.uint32).tobytes() + flags[at].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out_bin, pa.int32()), pa.array(out_data, pa.binary())], ["bin", "data"])

    def rows(keys: np.ndarray, nodes: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut].view(np.int64)) for x in (keys, nodes)] + [pa.array((flags[cut] & 1).astype(bool)), pa.array((flags[cut] >> 1).astype(np.int8))], ["key", "node", "upper", "need"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packs in groupby(((b, d) for batch in batches for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), key=lambda x: x[0]):
            held = []
            for _, data in packs:
                if data[:1] == b"H":
                    n = len(data) // 17
                    yield from rows(np.frombuffer(data, np.uint64, n, 1), np.frombuffer(data, np.uint64, n, 1 + 8 * n), np.frombuffer(data, np.uint8, n, 1 + 16 * n))
                    continue
                n, m = np.frombuffer(data, np.uint64, 2, 1).tolist()
                keys, names = np.frombuffer(data, np.uint64, n, 17), np.frombuffer(data, np.uint64, m, 17 + 8 * n)
                index = np.frombuffer(data, np.uint32, n, 17 + 8 * n + 8 * m)
                held.append((keys, names[index], np.frombuffer(data, np.uint8, n, 17 + 12 * n + 8 * m)))
            if not held:
                continue
            keys, nodes, flags = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            order = order[np.lexsort((nodes[order], keys[order]))]
            keys, nodes, flags = keys[order], nodes[order], flags[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))[: len(keys)]
            keys, nodes, flags = keys[new], nodes[new], flags[new]
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            lower = np.add.reduceat(1 - (flags & 1).astype(np.int64), first)
            use = np.repeat((size > 1) & (lower > 0), size)
            yield from rows(keys[use], nodes[use], flags[use])

    dealt = texts.mapInArrow(deal, "bin int, data binary").repartition(parts, "bin").sortWithinPartitions("bin")
    return dealt.mapInArrow(count, "key long, node long, upper boolean, need tinyint")


def _enough(dealt: DataFrame) -> DataFrame:
    """``key, node, leader`` of the keys that two nodes still have when nodes with fewer keys in common than they need are gone.

    Rows that come up twice (members of hot keys) only ever count in favour of a node. leader is the first node of a key in one of HUBS
    shuffled orders, chosen by the key: a family that has all its keys in common is tied to as many of its members, not to one
    that may stand at its edge, and yet to so few that the ties are linear in its size.
    """
    enough = dealt.groupBy("node", "upper").agg(F.count("*").alias("has"), F.max("need").alias("need")).where("has >= need").select(F.struct("node", "upper").alias("at"))
    rows = dealt.select(F.struct("node", "upper").alias("at"), "key").join(enough, "at", "left_semi").select("key", "at.node", "at.upper")
    place = F.xxhash64("node", F.pmod("key", F.lit(HUBS)))
    kinds = rows.groupBy("key").agg(F.min_by("node", place).alias("leader"), F.min("node").alias("first"), F.max("node").alias("last"), F.min("upper").alias("upper"))
    kinds = kinds.where("first <> last AND NOT upper").select(F.struct("key").alias("at"), "leader")
    return rows.select(F.struct("key").alias("at"), "node").join(kinds, "at").select("at.key", "node", "leader").distinct()


def _candidate_sets(source: DataFrame, named: DataFrame, shared: DataFrame, words: int) -> DataFrame:
    """``node, n, sketch, thin, codes`` of every node that shares a key, from one document of each."""
    chosen = named.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("tie").alias("tie"))
    texts = source.select("tie", "text").join(chosen, "tie").select("node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in batches_of(batch.column(1).to_pylist()):
                codes, counts = shingle_sets(part, words)
                nodes = batch.column(0).slice(at, len(part))
                if (nodes_of(codes, counts).view(np.int64) != nodes.to_numpy(zero_copy_only=False)).any():
                    raise RuntimeError("the documents changed between two reads: near_duplicates needs a stored table")
                sets = np.split(codes, np.cumsum(counts)[:-1])
                sketches = [sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([nodes, pa.array(counts.astype(np.int64)), pa.array(sketches, pa.binary()), pa.array([thin(s) for s in sketches], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "sketch", "thin", "codes"])

    return texts.mapInArrow(build, "node long, n long, sketch binary, thin binary, codes binary")


def _most_apart(na: int, nb: int, percent: int) -> int:
    return (100 - percent) * (na + nb) // (100 + percent)


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link. Sizes and sketches first, then the sets of those that are left.

    ``a`` is the leader of a group, so it may be hot: joins shuffle both sides as they are, which AQE can split.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (na, nb, sa, sb) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(2, 6)])):
                if 100 * min(na, nb) >= percent * max(na, nb) and apart(set_places(sa), set_places(sb)) <= _most_apart(na, nb, percent):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (ca, cb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(ca, np.uint64), np.frombuffer(cb, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    def side(*columns: str, to: str) -> DataFrame:
        return members.select(F.col("node").alias(to), *[F.col(c).alias(f"{c}_{to}") for c in columns])

    def by_leader(rows: DataFrame, *columns: str) -> DataFrame:
        known = members.select(F.struct("node").alias("at"), *[F.col(c).alias(f"{c}_a") for c in columns])
        return rows.withColumn("at", F.struct(F.col("a").alias("node"))).join(known, "at").drop("at")

    near = by_leader(pairs, "n", "sketch").join(side("n", "sketch", to="b"), "b")
    near = near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(bounded, "a long, b long")
    sets = by_leader(near, "codes").join(side("codes", to="b"), "b")
    return sets.select("a", "b", "codes_a", "codes_b").mapInArrow(exact, "a long, b long")


def _across(shared: DataFrame, roots: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within the sketch bound, in keys of three members or more.

    (Of two members one is the leader, and the pair has been verified.) A key with more than BLOCK
    members is compared block against block, each pair of blocks a group of its own.
    """
    placed = shared.join(roots, "node", "left").select("key", "node", "leader", F.coalesce("root", "node").alias("root"))
    kinds = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    kinds = kinds.where("low <> high AND size > 2").select(F.struct("key").alias("at"), (F.col("size") / BLOCK + 1).cast("int").alias("blocks"))
    rows = placed.select(F.struct("key").alias("at"), "node", "leader", "root").join(kinds, "at").select(F.col("at.key").alias("key"), "node", "leader", "root", "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "leader", "root")
    rows = rows.distinct().join(members.select("node", "n", F.col("thin").alias("sketch")), "node")
    # bucket is a hash of the whole group, so that one key's groups spread
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "own", "node", "leader", "root", "n", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        each = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for (_, i, j), group in groupby(each, key=lambda r: r[:3]):
            rows = list(group)
            for x, y in _passing(rows, i, j, percent):
                a.append(min(x, y))
                b.append(max(x, y))
            if len(a) > 50_000:
                yield _pairs(a, b)
                a, b = [], []
        if a:
            yield _pairs(a, b)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    once = sorted(set(zip(a, b)))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in once], pa.int64()), pa.array([y for _, y in once], pa.int64())], ["a", "b"])


def _passing(rows: list[tuple], i: int, j: int, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one group of a key: of different components, not with their leader, within the bound."""
    own, node, leader, root, n = (np.array(x, np.int64) for x in list(zip(*rows))[3:8])
    names, index, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    largest = index == count.argmax()
    bits, places = np.stack([coarse(r[8]) for r in rows]), [set_places(r[8]) for r in rows]
    if any(r[8][:1] == b"F" for r in rows):
        places = [odd_places(p & np.uint16(FOLDED - 1)) for p in places]
    # members of the largest component meet the others from the others' side
    for x in np.flatnonzero(~largest).tolist():
        later = np.arange(len(rows)) > x
        use = np.flatnonzero((root != root[x]) & (largest | later) & ((own[x] != own) | (i == j)) & (node != leader[x]) & (node[x] != leader))
        use = use[100 * np.minimum(n[use], n[x]) >= percent * np.maximum(n[use], n[x])]
        if len(use):
            most = (100 - percent) * (n[use] + n[x]) // (100 + percent)
            near = np.bitwise_count(bits[use] ^ bits[x]).sum(1, dtype=np.int64) <= most
            for y, bound in zip(use[near].tolist(), most[near].tolist()):
                if apart(places[x], places[y]) <= bound:
                    yield int(node[x]), int(node[y])
