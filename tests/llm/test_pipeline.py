"""The five stages against brute force, and the queries against their SQL."""

import collections
import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from retrace.llm import langid, mixing, queries
from tests.llm.test_operators import LOWER, WORD, components, fill, texts


def _repeated(spark, path):
    """A row three times over, and another with no id."""
    spark.createDataFrame([(1, "same text")] * 3 + [(None, "other")], "doc_id long, text string").write.parquet(f"{path}/repeated")
    return f"{path}/repeated"


def test_stages(spark, sf, tmp_path):
    docs = queries.documents(spark, sf)
    kept = pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {i for i, _ in texts(docs)} - {i for i, _ in texts(kept)} <= {i for i, t in texts(docs) if sum(c.isalpha() for c in t) < 40}
    once = pipeline.exact(spark, docs, sf)
    lowered = {}
    for i, t in texts(docs):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        lowered[t] = max(lowered.get(t, -1), i)
    assert sorted(i for i, _ in texts(once)) == sorted(lowered.values()) and once.columns == docs.columns
    assert pipeline.exact(spark, spark.read.parquet(_repeated(spark, tmp_path)), sf).count() == 2
    apart = pipeline.near(spark, docs, sf)
    assert sorted(i for i, _ in texts(apart)) == sorted(i for i, _, c in components(texts(docs), 5, 80) if i == c)
    mixed = pipeline.mixture(spark, docs, sf)
    assert mixed.columns == docs.columns and 1.4 < sum(len(t.split()) for _, t in texts(mixed)) / sum(len(t.split()) for _, t in texts(docs)) < 1.6


def mixed(items):
    """The mix in plain Python: (doc_id, text) as often as taken. items: doc_id, text, source of rows with distinct ids."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = collections.defaultdict(list)
    for i, t, source in items:
        sources[source].append((hashlib.md5(str(i).encode()).hexdigest(), i, t))
    target = fill({s: sum(size(t) for _, _, t in rows) for s, rows in sources.items()})
    out = []
    for source, rows in sources.items():
        left = math.floor(target[source] + 0.5)
        for _ in range(2):
            for _, i, t in sorted(rows):
                n = size(t)
                words = max(0, min(n, left))
                left -= n
                if words and 2 * words >= n:
                    out.append((i, t))
    return out


def test_run(spark, sf):
    """The whole pipeline in plain Python: which documents stay, how often each is taken, and the library's ids of every one."""
    from tokenizers import Tokenizer

    docs = queries.documents(spark, sf)
    langs, likely = langid.train(docs.where(~queries.held_out(F.col("doc_id"))))
    items = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    spoken = []
    for i, t, source in items:
        counts, has = langid.trigrams([t or ""])
        if has[0] and round(float(langid.infer(counts, likely).max()), 4) >= pipeline.LEAST_SCORE:
            spoken.append((i, t, source))
    last = {}
    for i, t, _ in spoken:
        last[t.translate(LOWER)] = max(last.get(t.translate(LOWER), -1), i)
    once = [x for x in spoken if x[0] in set(last.values())]
    firsts = {i for i, _, c in components([x[:2] for x in once], pipeline.WORDS, pipeline.PERCENT) if i == c}
    taken = mixed([x for x in once if x[0] in firsts])
    theirs = Tokenizer.from_file(queries.tokenizer_path())
    encoded = {t: tuple(theirs.encode(t, add_special_tokens=False).ids) for _, t in taken}
    sha = lambda ids: hashlib.sha256(theirs.decode(list(ids), skip_special_tokens=False).encode()).hexdigest()
    want = collections.Counter((i, len(encoded[t]), encoded[t], sha(encoded[t])) for i, t in taken)
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in out.collect()) == want and len(want) > 50


def test_stages_on_awkward_rows(spark, docs, no_docs, sf, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns in every stage; empty tables give empty results."""
    for name, stage in pipeline.STAGES:
        for table, empty in ((docs, False), (no_docs, True)):
            out = stage(spark, table, sf)
            rows = out.collect()
            assert (not rows) == empty, name
            if name != "tokens":
                assert out.columns == docs.columns
                known = collections.Counter(map(str, docs.collect()))
                got = collections.Counter(map(str, rows))
                assert set(got) <= set(known), name
                assert name == "mixture" or all(n <= known[r] for r, n in got.items()), name
    assert pipeline.tokens(spark, docs, sf).count() == docs.count()
    order = [r["position"] for r in mixing.mix(docs, ordered=True).selectExpr("get(copies, 0).position AS position").collect()]
    assert [p for p in order if p is not None] == sorted(p for p in order if p is not None)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, sf).select(*[F.col(c).cast("string") for c in columns]).toPandas()
    want = con.sql(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)} FROM ({queries.ORACLE_SQL[name]})").df()
    if "target" in columns:
        got["target"], want["target"] = got["target"].astype(float).round(5), want["target"].astype(float).round(5)
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
