"""A small corpus with the cases every operator has to stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("kept", T.StringType()), ("tie", T.LongType()))])


def corpus(seed: int = 5, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "rain", "falls", "over", "quiet", "hills", "and", "Every", "river", "sings", "é́tude", "größe", "niño", "日本", "x1", "token"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) + rng.choice([".", "", "\n", "!"]) for _ in range(n)]
    long_text = " ".join(rng.choice(words) for _ in range(6000))
    for i in range(0, n, 4):  # near copies
        parts = texts[i].split(" ")
        if len(parts) > 40:
            parts[rng.randrange(len(parts))] = "CHANGED"
            texts.append(" ".join(parts))
    texts += [texts[3]] * 30 + [texts[7].upper(), texts[7].lower(), None, None, "", "", " \n\t ", long_text, long_text + " end", "a\x00b", "---", "ab" * 900, "ab" * 901]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4], None if t is None else len(t), "k", "yes", 7) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id", "en", None, 5, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
