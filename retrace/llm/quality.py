"""Line-first cleaning: rules on every line remove lines; a document that loses too much text is rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The symbols that are counted, what ends a sentence, words that separate links, and phrases of boilerplate lines.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
ENDS = re.compile(r"""(?:[.!?…。！？:;]|[.!?]["”»)'’])\Z""")
SEPARATORS = set("|»›·•>/")
BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|uses? cookies|javascript (?:is )?(?:disabled|required)|"
    r"enable javascript|sign up|sign in|log in|subscribe|newsletter|click here|read more|share this|follow us|powered by|lorem ipsum|back to top|skip to content)\b", re.I)
#: Words from which a line may have the end of a sentence anywhere instead of at its own end.
LONG_LINE = 20
#: Symbols a word, separators a line, share of upper-case words, words of a line from which punctuation is asked for, share of words a document has to keep.
MOST_SYMBOLS, MOST_SEPARATORS, MOST_UPPER, LEAST_WORDS, LEAST_KEPT = 0.3, 2, 0.6, 4, 0.5
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines_removed array<struct<line:int,rule:string>>, words_kept long, kept boolean, clean_text string"


def failing_rule(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails: symbols, upper, navigation, boilerplate or punctuation."""
    n = len(words)
    if sum(line.count(c) for c in "#*$%&<>") > MOST_SYMBOLS * n:
        return "symbols"
    if sum(1 for w in words if w in SEPARATORS) > MOST_SEPARATORS:
        return "navigation"
    if n >= LEAST_WORDS and sum(1 for w in words if len(w) > 1 and w.isupper()) > MOST_UPPER * n:
        return "upper"
    if n < 25 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= LEAST_WORDS and not ENDS.search(words[-1]) and (n < LONG_LINE or not any(map(ENDS.search, words))):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that are found twice or more, the first one included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(upto, i)
            upto = i + 3
    return total


def judge(text: str) -> tuple:
    """One document: the fields of SCHEMA."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    repeats = repeated_words(words)
    seen: set[str] = set()
    removed, clean, left, twice = [], [], 0, 0
    for i, line in enumerate(text.split("\n")):
        own = line.encode("utf-8", "replace").split()
        if not own:
            clean.append(line)
            continue
        if line in seen:
            rule: str | None = "repeated"
            twice += 1
        else:
            seen.add(line)
            rule = failing_rule(line, [w.decode("utf-8", "replace") for w in own])
        if rule:
            removed.append({"line": i, "rule": rule})
        else:
            left += len(own)
            clean.append(line)
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, symbols, twice, repeats, failed, removed, left, not failed and left >= LEAST_KEPT * n, "\n".join(clean)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id`` and the fields of SCHEMA for every document, in one pass without a shuffle.

    Every line with a word is judged by itself: an earlier equal line, too many symbols, navigation
    separators, upper case, boilerplate phrases in a short line, or no end of a sentence removes it. A
    document stays if the base rules hold and at least half its words are in lines that stay. Null text:
    no words, so it fails. Empty tables give empty results; repeated rows are judged each by itself;
    texts of any length are read whole. ``with_text=False`` leaves clean_text null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [judge(t or "") for t in part.column(1).to_pylist()]
                columns = list(zip(*rows))
                if not with_text:
                    columns[-1] = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, TYPES)]], ["doc_id", *NAMES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_removed", "words_kept", "kept", "clean_text"]
TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.struct([("line", pa.int32()), ("rule", pa.string())])), pa.int64(), pa.bool_(), pa.string()]
