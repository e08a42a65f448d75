"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.llm.bpe import bpe_round_trip
from retrace.llm.exact_dedup import exact_dedup
from retrace.llm.html import extract_text
from retrace.llm.jaccard_join import near_duplicates
from retrace.llm.langid import identify, train
from retrace.llm.mixing import mix
from retrace.llm.quality import clean_lines
from retrace.llm.secrets import scan_secrets
from retrace.llm.sharding import byte_shards
from retrace.llm.suffix_dedup import remove_repeats

TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("tie")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_round_trip(documents(spark, sf_dir), tokenizer_path())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_shards(documents(spark, sf_dir))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "proportions")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the strings of 400 bytes that go: the words in passages of over 50 words that another document has as well."""
    done = remove_repeats(documents(spark, sf_dir), 400, 51)
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["begin"])
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), words.alias("n_passage_words"), (F.size("passages") > 0).alias("has_passage"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides what is taken of a document: the place in training, 0 to 1, of its first copy and of its second. In that order."""
    done = mix(documents(spark, sf_dir), ordered=True)
    place = lambda i: F.round(F.get("copies", F.lit(i))["position"], 6)
    return done.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", place(0).alias("position"), place(1).alias("second_position"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean_lines(documents(spark, sf_dir), with_text=False)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_secrets(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return done.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_html, op3_bpe, op4_shards, op5_language_id, op6_suffix_dedup, op7_mix, op8_quality, op9_secrets, op10_jaccard)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""",
    "op7_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
              CAST([1.5, 1.0, 0.5][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS early FROM d GROUP BY source),
        b AS (SELECT 1.5 * sum(source_size) AS budget FROM s),
        -- targets above twice the source are set to it and the rest is shared anew among the others, until none is above
        r AS (SELECT 0 AS step, source, source_size, CAST(w AS DOUBLE) AS w, false AS fixed, CAST((SELECT budget FROM b) * w / (SELECT sum(w) FROM s) AS DOUBLE) AS target FROM s
              UNION ALL
              SELECT step + 1, source, source_size, w, f, CASE WHEN f THEN 2.0 * source_size ELSE CAST(((SELECT budget FROM b) - coalesce(sum(CASE WHEN f THEN 2.0 * source_size END) OVER (), 0)) * w / sum(CASE WHEN f THEN 0 ELSE w END) OVER () AS DOUBLE) END
              FROM (SELECT *, fixed OR target >= 2.0 * source_size AS f FROM r) WHERE step < (SELECT count(*) FROM s)),
        t AS (SELECT source, source_size, target FROM r WHERE step = (SELECT max(step) FROM r)),
        p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        -- a source's demand at time t is early * t + (1 - early) * t * t of its target; a copy stands where the demand reaches its first word
        c AS (SELECT p.*, s.early, CAST(round(p.target) AS BIGINT) AS stop, least(1.0, CAST(start AS DOUBLE) / p.target) AS x, least(1.0, CAST(start + p.source_size AS DOUBLE) / p.target) AS y FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(greatest(0, least(size, stop - start)) + greatest(0, least(size, stop - start - source_size)) AS BIGINT) AS taken,
            CASE WHEN least(size, stop - start) > 0 THEN round(2 * x / (early + sqrt(early * early + 4 * (1 - early) * x)), 6) END AS position,
            CASE WHEN least(size, stop - start - source_size) > 0 THEN round(2 * y / (early + sqrt(early * early + 4 * (1 - early) * y)), 6) END AS second_position FROM c""",
    "op8_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        tokens AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
        windows AS (SELECT doc_id, i, CASE WHEN i + 2 <= len(w) THEN w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] END AS g FROM tokens),
        found AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM windows),
        repeats AS (SELECT doc_id, CAST(sum(m) AS BIGINT) AS n FROM (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM found) GROUP BY 1),
        lines AS (SELECT doc_id, l, i, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) > 1 AS again, len(w) AS n FROM lines WHERE len(w) > 0),
        judged AS (SELECT doc_id, n, again,
            length(regexp_replace(l, '[^#*$%&<>]', '', 'g')) > 0.3 * n
            OR len(list_filter(w, lambda x: x IN ('|', '»', '›', '·', '•', '>', '/'))) > 2
            OR (n >= 4 AND len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) > 0.6 * n)
            OR (n < 25 AND regexp_matches(l, '(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|uses? cookies|javascript (?:is )?(?:disabled|required)|enable javascript|sign up|sign in|log in|subscribe|newsletter|click here|read more|share this|follow us|powered by|lorem ipsum|back to top|skip to content)\b'))
            OR (n >= 4 AND NOT regexp_matches(w[-1], $e$(?:[.!?…。！？:;]|[.!?]["”»)'’])$$e$) AND (n < 20 OR len(list_filter(w, lambda x: regexp_matches(x, $e$(?:[.!?…。！？:;]|[.!?]["”»)'’])$$e$))) = 0)) AS fails FROM numbered),
        kept AS (SELECT doc_id, sum(CASE WHEN again THEN 1 ELSE 0 END) AS twice, sum(CASE WHEN again OR fails THEN 0 ELSE n END) AS stays FROM judged GROUP BY 1),
        base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(k.twice, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(stays, 0) AS stays FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN kept k USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND stays >= 0.5 * n_words AS kept FROM base""",
    "op10_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
        r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op4_shards": r"""
        WITH RECURSIVE bits AS (SELECT i, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
        crc AS (SELECT list(c ORDER BY i) AS tbl FROM bits WHERE step = 8),
        d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, size, list_transform(range(size - 1), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS b FROM d),
        c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32) AS upto, sum(size) OVER () AS total FROM c),
        s AS (SELECT *, CAST(least(15, (2 * upto - size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}
