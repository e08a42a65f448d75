"""BPE encoding and decoding with the merges of a public tokenizer file, on a contiguous rank array."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a word up to which the rank array is scanned; beyond it a heap gives the same order of merges.
SHORT = 64
#: Words a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Words that are merged side by side, and documents that are encoded together.
AT_ONCE, DOCS_AT_ONCE = 4096, 1024
NO_RANK = 1 << 60
#: Slots of the hash table of pairs, and the multiplier whose top 21 bits choose one.
SLOTS, SPREAD = 1 << 21, 0x9E3779B97F4A7C15
SEPARATORS = re.compile("[\x1c-\x1f]")
# The library's letters and numbers are those of Unicode 16, whose additions to Unicode 15.1 are these.
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
# Lower case that the library knows beyond Unicode 15.1, as ranges and what to add to them.
LOWER_PAIRS = (("1C89", 1), ("A7CB", 0x264 - 0xA7CB), ("A7CC", 1), ("A7CE", 1), ("A7D2", 1), ("A7D4", 1), ("A7DA", 1), ("A7DC", 0x19B - 0xA7DC), ("10D50-10D65", 0x20), ("16EA0-16EB8", 0x1B))
# Marks with a combining class, younger than the library's tables for NFC, which reorder and compose nothing across them.
PLAIN_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E 11943 "
    "119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF")
SPACE = regex.compile(r"\p{White_Space}+")


def code_points(ranges: str) -> list[int]:
    """The code points of hexadecimal ranges."""
    return [c for r in ranges.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1)]


def char_class(points: list[int]) -> str:
    """A class of a regular expression that holds the code points, as ranges."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out) + "]"


def other_class(name: str, known: str) -> list[int]:
    """Code points that are letters (L) or numbers (N) to the regular expressions here but not to the library."""
    old = set(code_points(known))
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    return [c for m in regex.finditer(rf"\p{{{name}}}", every) if unicodedata.category(m[0])[0] != name and (c := ord(m[0])) not in old]


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where it prints, else the next from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in printing else next(spare)) for b in range(256)]


class Bpe:
    """A tokenizer of kind BPE with an end-of-word suffix: NFC, lower case, white space dropped.

    Encodes as the library that the file is for does without added special tokens; strings of the
    special tokens inside a text become their ids. decode joins the tokens by one space, which is what
    the library does for a file without a decoder.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: What each merge makes, and the rank of a pair: in a dict, and in a hash table that numpy can search.
        self.made = np.array([self.vocab[x + y] for x, y in pairs], np.int64)
        keys = np.array([self.vocab[x] << 32 | self.vocab[y] for x, y in pairs], np.int64)
        self.ranks: dict[int, int] = {k: i for i, k in reversed(list(enumerate(keys.tolist())))}
        self.table_keys, self.table_ranks = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NO_RANK, np.int64)
        for k, i in self.ranks.items():
            at = (k * SPREAD & 0xFFFFFFFFFFFFFFFF) >> 43
            while self.table_keys[at] >= 0:
                at = (at + 1) % SLOTS
            self.table_keys[at], self.table_ranks[at] = k, i
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = {i: t for t, i in {**self.vocab, **special}.items()}
        split = next(p for p in stored["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + "| "
        self.words_and_spaces = regex.compile(pattern)
        # the same for texts with characters on which Unicode's versions differ
        letters, numbers = other_class("L", LETTERS_16), other_class("N", NUMBERS_16)
        self.lower_pairs = {c: c + more for r, more in LOWER_PAIRS for c in code_points(r)}
        self.plain_marks = regex.compile(f"({char_class(code_points(PLAIN_MARKS))})")
        self.differs = regex.compile(char_class([*letters, *numbers, *self.lower_pairs, *code_points(PLAIN_MARKS)]))
        for name, points in (("L", letters), ("N", numbers)):
            pattern = pattern.replace(rf"[\p{{{name}}}]", rf"\p{{{name}}}").replace(rf"\p{{{name}}}", f"[\\p{{{name}}}--{char_class(points)}]" if points else rf"\p{{{name}}}")
        self.words_by_table = regex.compile(pattern, regex.V1)
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in symbols], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in symbols], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; NO_RANK where they don't merge. Probes the slots of each key in turn."""
        keys = left << 32 | right
        at = ((keys.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(43)).astype(np.int64)
        found = self.table_keys[at]
        out = np.where(found == keys, self.table_ranks[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % SLOTS
            got = self.table_keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.table_ranks[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def short_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words of like length at once.

        Each word has a row of parts and beside it a row of the ranks of adjacent parts. Again and
        again every row is scanned for its least rank (the left one of equals), the boundary there is
        deleted by moving the rest of the row up, and the ranks on both sides are looked up anew. Rows
        in which nothing merges any more leave.
        """
        lens = np.array([len(w) for w in words])
        width = int(lens.max())
        inside = np.arange(width) < lens[:, None]
        parts = np.zeros((len(words), width), np.int64)
        parts[inside] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        parts[np.arange(len(words)), lens - 1] = self.last[ends]
        ranks = np.full((len(words), width), NO_RANK, np.int64)  # one column more than pairs
        if width > 1:
            pair = inside[:, 1:]
            ranks[:, :-1][pair] = self.rank_of(parts[:, :-1][pair], parts[:, 1:][pair])
        out: list[list[int]] = [[]] * len(words)
        row, column = np.arange(len(words)), np.arange(width)
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            over = least == NO_RANK
            if over.any():
                for i, ids, n in zip(row[over].tolist(), parts[over].tolist(), lens[over].tolist()):
                    out[i] = ids[:n]
                going = ~over
                row, parts, ranks, lens, at, least = row[going], parts[going], ranks[going], lens[going], at[going], least[going]
                if not len(row):
                    return out
            here = np.arange(len(row))
            after = np.minimum(column + (column > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, after, 1)
            parts[here, at] = self.made[least]
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            lens = lens - 1
            ranks[here, at] = NO_RANK
            more = np.flatnonzero(at + 1 < lens)
            ranks[more, at[more]] = self.rank_of(parts[more, at[more]], parts[more, at[more] + 1])
            more = np.flatnonzero(at > 0)
            ranks[more, at[more] - 1] = self.rank_of(parts[more, at[more] - 1], parts[more, at[more]])

    def long_word(self, word: bytes) -> list[int]:
        """The same merges in the same order from a heap, for words on which repeated scans would be quadratic."""
        parts = self.inner[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.last[word[-1]])
        n, of = len(parts), self.ranks.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := of(parts[i] << 32 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := of(parts[x] << 32 | parts[y], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of what stands between white space; no word of the pre-tokenizer reaches across it."""
        other = {c for c in chunks if not c.isascii() and self.differs.search(c)}
        if other:
            text = " ".join(other)
            text = "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(self.plain_marks.split(text)))
            self.learn_words(list(other), self.words_by_table.findall(text.replace("Σ", "σ").lower().translate(self.lower_pairs)))
            chunks = [c for c in chunks if c not in other]
        text = " ".join(chunks)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would choose a final sigma by context
        self.learn_words(chunks, self.words_and_spaces.findall(text.lower()))

    def learn_words(self, chunks: list[str], found: list[str]) -> None:
        """Remembers the ids of chunks, whose words stand in ``found`` with a space between chunks."""
        words = {w: w.encode("utf-8", "replace") for w in set(found)}
        words.pop(" ", None)
        ids: dict[str, list[int]] = {w: self.long_word(data) for w, data in words.items() if len(data) > SHORT}
        short = sorted((w for w in words if w not in ids), key=lambda w: len(words[w]))
        for at in range(0, len(short), AT_ONCE):
            part = short[at : at + AT_ONCE]
            ids.update(zip(part, self.short_words([words[w] for w in part])))
        ids[" "] = []
        own: list[int] = []
        each = iter(chunks)
        for w in found:
            if w == " ":
                self.known[next(each)] = tuple(own)
                own = []
            else:
                own += ids[w]
        for chunk in each:
            self.known[chunk] = tuple(own)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        pieces: list[list[int | list[str]]] = []
        for text in texts:
            parts = self.special_pattern.split(text) if self.special_pattern is not None and self.special_pattern.search(text) else [text]
            # str.split() also parts at \x1c to \x1f, which are no white space to the tokenizer
            pieces.append([self.special[p] if i % 2 else p.split() if not SEPARATORS.search(p) else [c for c in SPACE.split(p) if c] for i, p in enumerate(parts)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(p for text in pieces for p in text if isinstance(p, list))).difference(self.known)
        if new:
            self.learn(list(new))
        of = self.known.__getitem__
        return [list(chain.from_iterable([p] if isinstance(p, int) else chain.from_iterable(map(of, p)) for p in text)) for text in pieces]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One per worker process."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, in one pass over Arrow batches without a shuffle.

    ``path`` is the tokenizer's file, present on every executor. A null or empty text has no ids. Words
    are encoded once per worker and remembered up to a bound. Rows keep their number, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids = bpe.encode_many([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every whole text and what they decode to; otherwise as ``bpe_encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids = bpe.encode_many([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
