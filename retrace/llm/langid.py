"""Language ID by multilingual mixture inference: EM over n-gram likelihoods, penalised choice of the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins into which trigrams of character classes are hashed.
BINS = 4096
#: Rows per language that training may use, the first by md5 of the id: the bound of the labelled sample.
TRAIN_ROWS = 4000
STEPS, PENALTY = 15, 8.0
#: Texts and characters whose n-grams are counted together.
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 2_000_000


def letter_class(c: int) -> int:
    """A class of 0 to 63 for a code point: 0 no letter, a-z each its own, other letters hashed."""
    return 0 if not chr(c).isalpha() else c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 7) % 37


_CLASSES: np.ndarray | None = None


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed trigrams, a row per text, and whether it has a letter. No trigram reaches across texts.

    Every letter is the middle of one. Runs of characters that are no letters count as one, and so do both ends of a text, whatever
    stands beside it in the batch.
    """
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.array([letter_class(c) for c in range(0x110000)], np.uint32)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(f"\n{'\n'.join(lowered)}\n".encode("utf-32-le", "replace"), np.uint32)
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    classes = _CLASSES[codes]
    stay = np.ones(len(classes), bool)
    stay[1:] = (classes[1:] > 0) | (classes[:-1] > 0)
    classes, own = classes[stay], own[stay[1:]]
    a, b, c = classes[:-2], classes[1:-1], classes[2:]
    good = b > 0
    grams = ((a[good] << 12 | b[good] << 6 | c[good]) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
    flat = np.bincount(own[: len(good)][good] * BINS + grams, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    return flat.astype(np.float32), flat.any(1)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Cuts a batch into parts of bounded rows and characters; a longer text is a part by itself."""
    part: list[str] = []
    at = size = 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and (len(part) >= ROWS_AT_ONCE or size + len(t) > CHARS_AT_ONCE):
            yield at, part
            part, at, size = [], i, 0
        part.append(t)
        size += len(t)
    if part:
        yield at, part


def em(counts: np.ndarray, likely: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each text, and the log-likelihood they reach; a text without n-grams keeps equal ones."""
    n = counts.sum(1, keepdims=True)
    share = np.full((len(counts), likely.shape[0]), 1 / likely.shape[0], np.float32)
    for _ in range(steps):
        share *= np.where(n > 0, (counts / np.maximum(share @ likely, 1e-30)) @ likely.T / np.maximum(n, 1), 1)
    return share, (counts * np.log(share @ likely + 1e-30)).sum(1, dtype=np.float64)


def infer(counts: np.ndarray, likely: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions after the choice of the language set.

    The single best language is the first set. Where the likelihood of the full mixture can't beat it
    by one penalty, it is chosen. Otherwise sets of the two, three, ... languages with most in the full
    mixture are fitted, and the one with the best likelihood less ``penalty`` times the log of the
    number of n-grams for each further language is chosen.
    """
    n = np.maximum(counts.sum(1), 1)
    alone = counts @ np.log(likely).T
    best = alone.argmax(1)
    out = np.zeros((len(counts), likely.shape[0]), np.float32)
    out[np.arange(len(counts)), best] = 1
    if likely.shape[0] < 2:
        return out
    share, reached = em(counts, likely)
    cost = penalty * np.log(n + 1)
    value = alone.max(1).astype(np.float64)
    # what EM can still gain is bounded by the largest mean responsibility ratio
    slack = n * np.log(np.maximum(1, ((counts / np.maximum(share @ likely, 1e-30)) @ likely.T / n[:, None]).max(1)))
    open_ = np.flatnonzero(reached + slack - value > cost)
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, likely.shape[0] + 1):
        for i in open_.tolist():
            chosen = order[i, :size]
            own, got = em(counts[i : i + 1], likely[chosen])
            got = float(got[0]) - (size - 1) * cost[i]
            if got > value[i]:
                value[i] = got
                out[i] = 0
                out[i, chosen] = own[0]
        open_ = open_[reached[open_] + slack[open_] - size * cost[open_] > value[open_]]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of each bin in each, from at most ``rows_per_language`` rows of each.

    The rows are those of the smallest md5 of the id, found by a top-k per language with partial
    aggregation; counting them is distributed and what comes back has one row per language and bin.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # a fixed share of the md5 range that holds the bound, so no text is sorted
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, BINS), np.float32)
    upto = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(format(min(2**32 - 1, int(2**32 * min(1.0, rows_per_language / n))), "08x"))) for lang, n in sizes.items()])
    rows = rows.where(F.substring("key", 1, 8) <= upto).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                counts, _ = trigrams(part)
                for lang in set(langs[at : at + len(part)]):
                    own = [i for i, x in enumerate(langs[at : at + len(part)]) if x == lang]
                    total[lang] = total.get(lang, 0) + counts[own].sum(0, dtype=np.float64)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.float64())], ["lang", "bin", "n"])

    found = rows.mapInArrow(count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    langs = sorted(sizes)
    table = np.full((len(langs), BINS), 0.5)
    for r in found:
        table[langs.index(r["lang"]), r["bin"]] += r["n"]
    return langs, (table / table.sum(1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, proportions`` for every whole text; only the text is looked at.

    lang_pred is the language with most of the text, score its proportion, proportions all of the chosen
    set. ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go
    to the first language by name. Rows keep their number, repeated ones too; a text of any length is
    counted to its end. A row's result doesn't depend on the rows beside it; figures are rounded to four places, as the last digits
    of a product of matrices do. An empty table gives an empty result.
    """
    langs, likely = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                counts, has = trigrams(texts)
                share = infer(counts, likely) if len(langs) else np.zeros((len(texts), 1), np.float32)
                top = share.argmax(1)
                known = has & (len(langs) > 0)
                names = [langs[t] if k else "und" for t, k in zip(top.tolist(), known.tolist())]
                score = np.where(known, np.clip(share[np.arange(len(texts)), top], 0, 1), 0).astype(np.float64).round(4)
                parts = [{lang: round(float(x), 4) for lang, x in zip(langs, row) if x > 0} if k else {} for row, k in zip(share, known.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(score), pa.array([list(p.items()) for p in parts], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "proportions"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, proportions map<string,double>")
