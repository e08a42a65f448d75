"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again.

Every stage takes any columns beside doc_id, text, lang and source, whatever they are called, and all but the last return them as they were. A
row is known by its place in the stored table, so repeated rows and null ids are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.llm import queries
from retrace.llm.bpe import bpe_round_trip
from retrace.llm.common import Scratch
from retrace.llm.exact_dedup import exact_dedup
from retrace.llm.jaccard_join import near_duplicates
from retrace.llm.langid import identify, train
from retrace.llm.mixing import mixed_documents

#: A document whose best language makes up less of it is rejected, as one without letters is.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, and the similarity in percent.
WORDS, PERCENT = 5, 80
PLACE = "_place_in_the_table"


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row, by which a stage says what stays; every stage reads a stored table."""
    return docs.withColumn(PLACE, F.monotonically_increasing_id())


def keep_rows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place is among ``places``, with the columns of ``docs``."""
    return placed(docs).join(places.toDF(PLACE), PLACE, "left_semi").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (null or no letters), or of which none makes up half, go. Equal shares go to the first language by name."""
    model = train(docs.where(~queries.held_out(F.col("doc_id"))))
    found = identify(placed(docs), model, id_col=PLACE)
    return keep_rows(docs, found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays, one of them if it repeats; null ids are below all."""
    return keep_rows(docs, exact_dedup(docs).where("kept").select("tie"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document with the smallest doc_id stays, one of them if it repeats; null ids are above all.

    Texts without words are near nothing and stay.
    """
    return keep_rows(docs, near_duplicates(docs, words=WORDS, percent=PERCENT).where("kept").select("tie"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix takes it, in the order of training. Texts without words (null too) are not taken; a null source is one of its own."""
    return mixed_documents(docs, whole=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: the ids of every row, their number and what they decode to; of a null or empty text none, and the hash of nothing."""
    done = bpe_round_trip(docs, queries.tokenizer_path())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: Language models, md5-ordered mixing over filtered sources and BPE have no SQL form; tests hold run() against a version in plain Python,
#: stage by stage and as a whole, but for the language model's probabilities, which are tested by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
