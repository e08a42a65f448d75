"""Secret scan: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A run that is too short for the filter is dropped either way, so the scan may ask for the length at once
#: where a shorter match can't hide a longer one; an assignment that is too short does hide what it covers.
SCAN = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Labelled samples of each class; nats per character by which a secret has to look more random.
SAMPLES, MARGIN = 4000, 0.35
#: Least length of a secret the models judge, and nats it has to bring in all; what parts words in a run; nats by which a running sum may fall before a random part ends.
LEAST, TOTAL, SEPARATOR, DROP = 16, 7.0, r"[/=_+-]", 6.0
# Parts of ordinary identifiers, words and paths.
PARTS = (
    "get set user name file path list item count index value key data type node tree map hash load save read write open close "
    "first last next prev start stop begin end time date year month day hour table column row field record string number "
    "error message handler factory builder manager service client server request response session config option default "
    "public private static final class method function return import module package version license apache copyright "
    "the and that with for from this have which their would there about other into more some could them than then "
    "der die und den von mit das des ein eine nicht auch sich wird werden einer keit heit schaft ung lich ver ber "
    "les des une que pour dans est pas avec sur tion ment elle eau aux ier ouvre eux la el los las con para por una "
    "cion mente ado ezado que no se del arr oll http www com org net html index page example image content main"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text, label``: n random strings (label 1: hex of either case, base64, letters and digits), n identifiers in several styles and n / 8 other
    ordinary strings (label 0): numbers, dates, rules of one character, letters and digits in their own order.

    All are made by rule from the row number, so training is repeatable and needs no stored model.
    """
    rows = spark.range(n).select(F.col("id"), F.sha2(F.concat(F.lit("s"), F.col("id")), 512).alias("h"))
    b64 = F.base64(F.unhex("h"))
    kind = F.col("id") % 5
    random = rows.select(F.when(kind == 0, F.substring("h", 1, 40)).when(kind == 1, F.upper(F.substring("h", 1, 40))).when(kind == 2, F.substring(F.regexp_replace(b64, r"[\r\n]", ""), 1, 44)).otherwise(F.substring(F.regexp_replace(b64, r"[^A-Za-z0-9]", ""), 1, 40)).alias("text"), F.lit(1).alias("label"))
    parts = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda i: F.element_at(parts, (F.conv(F.substring("h", 8 * i + 1, 6), 16, 10).cast("long") % len(PARTS) + 1).cast("int"))
    words = F.array(*[pick(i) for i in range(6)])
    style = F.col("id") % 6
    camel = F.array_join(F.transform(words, lambda w: F.initcap(w)), "")
    text = F.when(style == 0, F.array_join(words, "_")).when(style == 1, camel).when(style == 2, F.array_join(words, "-")).when(style == 3, F.array_join(words, "/")).when(style == 4, F.concat_ws("_", F.upper(F.array_join(words, "_")), F.col("id").cast("string"))).otherwise(F.array_join(words, ""))
    names = rows.select(text.alias("text"), F.lit(0).alias("label"))
    # fewer of the rest, so that names still make up what is ordinary about letters
    number = F.substring(F.regexp_replace("h", "[a-f]", ""), 1, 24)
    rule = F.repeat(F.substring(F.lit("-=_/+"), (F.floor(F.col("id") / 32) % 5 + 1).cast("int"), F.lit(1)), 40)
    ordered = F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    kind = F.floor(F.col("id") / 8) % 4
    rest = rows.where("id % 8 = 0").select(F.when(kind == 0, number).when(kind == 1, F.regexp_replace(number, "(....)(..)(..)", "$1-$2-$3-")).when(kind == 2, rule).otherwise(ordered).alias("text"), F.lit(0).alias("label"))
    return random.unionByName(names).unionByName(rest)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every pair of neighbouring characters.

    Counts are taken on the cluster; what comes to the driver has at most two rows per pair of ALPHABET.
    Characters outside it stand for nothing and are skipped.
    """
    k = len(ALPHABET)
    chars = F.split("text", "")
    pairs = samples.where(F.length("text") > 1).select("label", F.explode(F.zip_with(F.slice(chars, 1, F.length("text") - 1), F.slice(chars, 2, F.length("text") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {0: [1.0] * (k * k), 1: [1.0] * (k * k)}
    for label, pair, n in pairs.groupBy("label", "pair").count().collect():
        a, b = ALPHABET.find(pair[0]), ALPHABET.find(pair[1:])
        if a >= 0 and b >= 0:
            counts[label][a * k + b] += n
    out = []
    for a in range(k):
        rows = {label: counts[label][a * k : a * k + k] for label in counts}
        totals = {label: sum(row) for label, row in rows.items()}
        out += [round(math.log(rows[1][b] / totals[1]) - math.log(rows[0][b] / totals[0]), 5) for b in range(k)]
    return out


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern as an array of (start, end, kind, match), code points, end exclusive.

    split() gives what lies between the matches, so positions are running sums of lengths. They are
    summed in blocks of the root of their number: no array is copied once per match.
    """
    gaps, whole, part = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    made = F.struct(gaps.alias("gaps"), whole.alias("whole"), part.alias("part"))

    def spans(m: Column) -> Column:
        n = F.size(m["whole"])
        lens = F.zip_with(F.slice(m["gaps"], F.lit(1), n), m["whole"], lambda g, w: F.length(g) + F.length(w))
        side = F.ceil(F.sqrt(n)).cast("int")
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / side).cast("int")), lambda b: total(F.slice(lens, b * side + 1, side)))
        known = F.struct(lens.alias("lens"), blocks.alias("blocks"))

        def from_sums(s: Column) -> Column:
            starts = F.transform(s["blocks"], lambda _, b: total(F.slice(s["blocks"], F.lit(1), b)))

            def place(p: Column) -> Column:
                def one(match: Column, i: Column) -> Column:
                    b = F.floor(i / side).cast("int")
                    start = F.get(p, b) + total(F.slice(s["lens"], b * side + 1, i - b * side)) + F.length(F.get(m["gaps"], i))
                    return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), F.lit(kind).alias("kind"), match.alias("match"), F.length(F.get(m["part"], i)).alias("counts"))

                return F.transform(m["whole"], one)

            return F.flatten(F.transform(F.array(starts), place))

        return F.flatten(F.transform(F.array(known), from_sums))

    found = F.filter(F.flatten(F.transform(F.array(made), spans)), lambda x: x["counts"] >= least)
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>"))


def _unclaimed(run: Column, base: Column) -> Column:
    """What base spans leave of a run, as an array of (start, end), pieces of LEAST characters or more."""
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    cut = lambda done, a, b: F.when(b - a >= LEAST, F.concat(done, F.array(span(a, b)))).otherwise(done)
    claims = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.aggregate(
        claims, F.struct(run["start"].cast("int").alias("at"), none.alias("done")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).cast("int").alias("at"), cut(s["done"], s["at"], b["start"]).alias("done")),
        lambda s: cut(s["done"], s["at"], run["end"]))


def _random_segments(llr: Column, index: Column, margin: float, word: Column) -> Column:
    """The parts of a run that look random, as an array of (start, end) in it: LEAST characters or more, ``margin`` nats a pair above ordinary.

    The whole run if its mean is above the margin. Else what a running sum finds, which begins anew where it falls to nothing or
    by DROP below its highest value and ends at that value, and every stretch between separators whose own mean is above the margin. Where
    both find the same place, the stretch counts, as its ends are exact.
    """
    k = len(ALPHABET)
    kind = "array<struct<start:int,end:int>>"
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    state = lambda i, total, start, most, end, done: F.struct(i.cast("int").alias("i"), total.cast("double").alias("total"), start.cast("int").alias("start"), most.cast("double").alias("most"), end.cast("int").alias("end"), done.alias("done"))
    closed = lambda s: F.when(s["end"] - s["start"] >= LEAST, F.concat(s["done"], F.array(span(s["start"], s["end"])))).otherwise(s["done"])
    zero = F.lit(0)
    let = lambda x, f: F.get(F.transform(F.array(x), f), zero)

    def step(s: Column, gain: Column) -> Column:
        total = s["total"] + gain
        anew = state(s["i"] + 1, zero, s["i"] + 1, zero, s["i"] + 1, closed(s))
        higher = state(s["i"] + 1, total, s["start"], total, s["i"] + 2, s["done"])
        lower = state(s["i"] + 1, total, s["start"], s["most"], s["end"], s["done"])
        return F.when((total <= 0) | (total < s["most"] - DROP), anew).when(total > s["most"], higher).otherwise(lower)

    def from_gains(gains: Column) -> Column:
        mean_above = lambda a, b: F.aggregate(F.slice(gains, a + 1, b - a - 1), F.lit(0.0), lambda t, g: t + g) > F.greatest(F.lit(0.0), TOTAL - margin * (b - a - 1))
        scanned = F.aggregate(gains, state(zero, zero, zero, zero, zero, F.array().cast(kind)), step, closed)
        lengths = F.transform(F.split(word, SEPARATOR), F.length)
        stretches = F.aggregate(lengths, F.struct(zero.alias("at"), F.array().cast(kind).alias("done")), lambda s, n: F.struct((s["at"] + n + 1).cast("int").alias("at"), F.when(n >= LEAST, F.concat(s["done"], F.array(span(s["at"], s["at"] + n)))).otherwise(s["done"]).alias("done")), lambda s: s["done"])
        parts = let(F.filter(stretches, lambda x: mean_above(x["start"], x["end"])), lambda exact: F.concat(exact, F.filter(_outside(scanned, exact), lambda x: mean_above(x["start"], x["end"]))))
        return F.when(mean_above(zero, F.length(word)), F.array(span(zero, F.length(word)))).otherwise(parts)

    def from_codes(codes: Column) -> Column:
        n = F.size(codes)
        return let(F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: F.get(llr, a * k + b) - margin), from_gains)

    return let(F.transform(F.split(word, ""), lambda c: F.get(index, F.ascii(c))), from_codes)


def _outside(found: Column, exact: Column) -> Column:
    """Spans without what the exact ones cover; pieces of LEAST characters or more stay."""
    return F.flatten(F.transform(found, lambda x: _unclaimed(x, exact)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, samples: DataFrame | None = None) -> DataFrame:
    """Every secret of every whole text: ``doc_id, base, found`` (arrays of start, end, kind, match).

    ``base`` has the matches of the fixed patterns; ``found`` those and, as kind ``markov``, every part of LEAST or more
    characters that the model of random strings explains better than that of identifiers, by ``margin`` nats
    a character and TOTAL in all: of runs of ALPHABET, less what base spans cover, whole runs or the random parts among
    ordinary neighbours (``_random_segments``). All of it is one projection over the scan:
    no shuffle, no Python. Null text: empty, no spans. Rows keep their number, repeated ones too.
    """
    spark = docs.sparkSession
    model = train(samples if samples is not None else labelled_samples(spark))
    llr = F.from_json(F.lit(json.dumps(model)), "array<double>")
    index = F.from_json(F.lit(json.dumps([max(0, ALPHABET.find(chr(c))) for c in range(128)])), "array<int>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind, pattern, group, least in BASE:
        rows = rows.withColumn(kind, _found(F.col("text"), kind, SCAN.get(kind, pattern), group, least))
    rank = F.from_json(F.lit(json.dumps({kind: i for i, (kind, *_) in enumerate([*BASE, ("markov",)])})), "map<string,int>")
    order = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match")))
    rows = rows.withColumn("base", order(F.concat(*[F.col(kind) for kind, *_ in BASE])))
    def parts(run: Column) -> Column:
        """Random parts of a run, each as a span of the text with its match."""

        def of(rest: Column) -> Column:
            word = F.substring(run["match"], rest["start"] - run["start"] + 1, rest["end"] - rest["start"])
            return F.transform(_random_segments(llr, index, margin, word), lambda x: F.struct((rest["start"] + x["start"]).alias("start"), (rest["start"] + x["end"]).alias("end"), F.lit("markov").alias("kind"), F.substring(run["match"], rest["start"] - run["start"] + x["start"] + 1, x["end"] - x["start"]).alias("match")))

        return F.flatten(F.transform(_unclaimed(run, F.col("base")), of))

    more = F.flatten(F.transform(_found(F.col("text"), "markov", CANDIDATE, 0, LEAST), parts))
    return rows.withColumn("found", order(F.concat(F.col("base"), more))).select("doc_id", *[kind for kind, *_ in BASE], "base", "found")
