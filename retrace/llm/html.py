"""Main text of web pages by nearest-URL page differencing, with the page's own structure as a guard."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.common import Scratch

# How elements are treated.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noframes noembed xmp svg canvas object audio video".split())
DROPPED = RAW | set("head nav header footer aside form button select menu dialog datalist search".split())
MAIN = set("article main".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table select article main section div nav header footer aside form body html blockquote".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
NOT_ARTICLE = set(
    "nav navbar navigation menu menubar sidebar sidebars breadcrumb breadcrumbs footer header masthead banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond pagination pager toc widget widgets skip copyright legal paywall".split())
#: What becomes of a block that no neighbour has, by its place, and which blocks make up the text.
FATES, KEPT = ("markup", "own", "article"), ("own", "article", "passage")
#: Two pages are near copies if what they share is all of the smaller one but a part in this many.
COPY_OF = 10

# a quote opens a value only right after "=", and an unclosed one is a character like others, so a tag is read once, from left to right
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMES = re.compile(r"[a-z]+")


def is_apart(name: str, rest: str, inside: bool = False) -> bool:
    """Whether an element by its attributes is no part of an article: a hidden one, a role, a class or id.

    Inside an article a class has to be one of the words as a whole: a share-price is no share button.
    """
    if not rest:
        return False
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role") in ROLES:
        return True
    names = found.get("class", "") + " " + found.get("id", "")
    words = set(names.split() if inside else _NAMES.findall(names))
    return bool(words & NOT_ARTICLE) and name not in ("html", "body") and name not in MAIN


def blocks_of(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its place: 2 inside an article, 1 elsewhere, 0 in what is none by its markup.

    Block elements part blocks; a line break and white space inside a block become one space. Unclosed
    and stray tags are taken as browsers do: an end tag closes what it matches, or nothing. The header
    of an article is part of it. The time is in proportion to the page, well formed or not.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, apart, in an article
    opened: Counter[str] = Counter()  # how many of each name are on the stack
    pieces: list[str] = []
    apart = main = False
    at, n = 0, len(page)

    def close() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append((text, 0 if apart else 2 if main else 1))

    def cut(depth: int) -> None:
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            pieces.append(page[at:])
            break
        pieces.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            pieces.append("\n")
            continue
        if tag[1]:
            if not opened[name]:
                if name == "p":
                    close()
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
            if any(x[0] in BLOCKS or x[1] for x in stack[depth:]):
                close()
            cut(depth)
        else:
            if name in BLOCKS or name in DROPPED:
                close()
            if name in BLOCKS:
                while stack and stack[-1][0] == "p":
                    cut(len(stack) - 1)
            for other in ENDED_BY.get(name, ()):
                for i in range(len(stack) - 1, -1, -1) if opened[other] else ():
                    if stack[i][0] == other:
                        cut(i)
                        break
                    if stack[i][0] in SCOPES:
                        break
            apart, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            own = name in DROPPED and not (main and name == "header") or is_apart(name, tag[3], main)
            if own and name not in BLOCKS:
                close()
            if name in RAW and name not in VOID and not tag[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if name not in VOID and not (tag[3].rstrip().endswith("/") and name not in BLOCKS):
                inside = name in MAIN or "articlebody" in tag[3].lower()
                stack.append((name, own or apart, (inside or main) and not own))
                opened[name] += 1
        apart, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    close()
    return out


#: Bits of the table of a longest common subsequence that are held at once; longer pages are split.
TABLE = 1 << 27


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Indexes of ``a`` in a longest common subsequence with ``b``.

    Lines that the other page hasn't are left out first, and a common start and end taken as they are. Of
    what is left, a row of the table is one integer, a bit per line. Where the table would be too large,
    the first page is split in halves and the other where their lengths add up to the most, which needs one row at a time.
    """
    both = set(a) & set(b)
    out: set[int] = set()
    parts = [([(x, i) for i, x in enumerate(a) if x in both], [x for x in b if x in both])]
    while parts:
        p, q = parts.pop()
        start, end = 0, min(len(p), len(q))
        while start < end and p[start][0] == q[start]:
            start += 1
        tail = 0
        while tail < end - start and p[-1 - tail][0] == q[-1 - tail]:
            tail += 1
        out |= {i for _, i in p[:start]} | {i for _, i in p[len(p) - tail :]}
        p, q = p[start : len(p) - tail], q[start : len(q) - tail]
        if len(p) * len(q) <= TABLE or len(p) < 2:
            out |= {p[k][1] for k in _common([x for x, _ in p], q)}
            continue
        half = len(p) // 2
        before = _lengths([x for x, _ in p[:half]], q)
        after = _lengths([x for x, _ in reversed(p[half:])], q[::-1])
        at = max(range(len(q) + 1), key=lambda j: before[j] + after[len(q) - j])
        parts += [(p[:half], q[:at]), (p[half:], q[at:])]
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Rows of the table: bit i is 0 where the length grows with line i of ``a``, a row for each start of ``b``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    yield v
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """The length of a longest common subsequence of ``a`` with each start of ``b``."""
    return [len(a) - v.bit_count() for v in _rows(a, b)]


def _common(a: list[int], b: list[int]) -> set[int]:
    rows = list(_rows(a, b))
    # walks back: a bit that is 0 in a row marks where the length grows
    out: set[int] = set()
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            out.add(i - 1)
            i, j = i - 1, j - 1
    return out


def _lines(page: str | None) -> tuple[list[tuple[str, int]], list[int]]:
    blocks = blocks_of(page or "")
    return blocks, [int(x) for x in np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t, _ in blocks], np.uint64).view(np.int64)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_partition: int = 20_000) -> DataFrame:
    """``page_id, url, text, blocks``: the main text of every page; blocks has each block with its fate.

    1. Pages become lines (text blocks). In the order of host and URL path every page is paired with the
       page before it, and with the one after it if they are of its host; the nearer is the one that shares the
       longer start of the path, the one before on a tie. Near copies of the page (``near_copy``: the same page under
       another URL, a repeated row) say nothing about what is its own and are passed over, however many they
       are, to the next page of the host that differs; if there is none, nothing is deleted.
    2. A longest common subsequence of all lines of the two pages, menus and adverts as well as the article's, is what they share; shared lines go.
    3. A guard keeps differencing right where pages have markup. Of what differencing left, the lines that menus, headers, footers, asides, forms,
       adverts and comments contain go as well, and of what it took, lines inside an article
       element stay, as the neighbour may carry the same article or passage. Lines without such markup are decided by
       steps 1 and 2 alone, on pages with an article element as on pages without one: an article element may
       wrap a teaser only, and the text stand beside it.

    A block's fate is one of ``shared`` (deleted by differencing), ``markup`` (by the guard alone), ``own`` (kept, as no
    neighbour has it), ``article`` (kept, inside an article), ``passage`` (the same, and kept by the guard alone).

    Pairing looks at urls and line hashes only; page text is shuffled once, with the lines to delete.
    Null html or no lines left: empty text. A null url is its own host, so those pages pair with each other.
    Repeated rows are copies like others. Empty table: empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.monotonically_increasing_id().alias("tie"))
    id_type = source.schema["page_id"].dataType.simpleString()

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[(h, len(t)) for h, (t, _) in zip(hashes, blocks)] for blocks, hashes in map(_lines, batch.column(2).to_pylist())]
            hashed, sizes = [[h for h, _ in x] for x in lines], [[n for _, n in x] for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashed, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["tie", "url", "lines", "sizes"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), F.lit(""))
    lines = source.select("tie", "url", "html").mapInArrow(hash_lines, "tie long, url string, lines array<long>, sizes array<int>").select("tie", host.alias("host"), path.alias("path"), "lines", "sizes")
    lines = scratch.keep(lines, "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // rows_per_partition + 1)
    ranged = scratch.keep(lines.repartitionByRange(parts, "host", "path", "tie").withColumn("part", F.spark_partition_id()), "ranged")
    scratch.drop("lines")
    deleted = scratch.keep(_shared_with_neighbour(ranged, scratch), "deleted")
    scratch.drop("ranged", "runs")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fates = [], []
            for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                left, kinds, drop = [], [], set(gone or ())
                for at, (text, place) in enumerate(blocks_of(page or "")):
                    fate = ("passage" if place == 2 else "shared") if at in drop else FATES[place]
                    if fate in KEPT:
                        left.append(text)
                    kinds.append(fate)
                texts.append("\n\n".join(left))
                fates.append(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(fates, pa.list_(pa.string()))], ["page_id", "url", "text", "blocks"])

    return source.join(deleted, "tie", "left").select("page_id", "url", "html", "gone").mapInArrow(extract, f"page_id {id_type}, url string, text string, blocks array<string>")


def near_copy(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> bool:
    """Whether two pages are one page twice over, by the characters of their lines: what they share is nearly all of the smaller and half of the larger.

    The second bound keeps a page of nothing but a menu from being a copy of every page with that menu.
    """
    left = Counter(b)
    shared = 0
    for x, n in zip(a, a_sizes):
        if left[x] > 0:
            left[x] -= 1
            shared += n
    less, more = sorted((sum(a_sizes), sum(b_sizes)))
    return COPY_OF * shared >= (COPY_OF - 1) * less and 2 * shared >= more


def _shared_with_neighbour(ranged: DataFrame, scratch: Scratch) -> DataFrame:
    """``tie, gone``: which of its lines each page shares with its nearest differing neighbour in the global order.

    Neighbours that are near copies form a run, and each page of a run is held against the last page
    before and the first page after the run. Inside a partition neighbours and run ends come from windows;
    one page and one run end per partition are handed across the borders, as far as a run goes.
    """
    page = F.struct("host", "path", "lines", "sizes")
    own = Window.partitionBy("part").orderBy("host", "path", "tie")
    back = Window.partitionBy("part").orderBy(F.col("host").desc(), F.col("path").desc(), F.col("tie").desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    rows = ranged.select("*", F.lag(page).over(own).alias("before"), F.lead(page).over(own).alias("after"))
    ends = ranged.groupBy("part").agg(F.min(F.struct("host", "path", "tie", "lines", "sizes")).alias("first"), F.max(F.struct("host", "path", "tie", "lines", "sizes")).alias("last"))
    order, order_back = Window.orderBy("part"), Window.orderBy(F.col("part").desc())
    thin = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("host", "path", "lines", "sizes")])
    ends = ends.select("part", F.lag(thin("last")).over(order).alias("border_before"), F.lead(thin("first")).over(order).alias("border_after"))
    rows = rows.join(ends, "part").select("tie", "part", "host", "path", "lines", "sizes", F.coalesce("before", "border_before").alias("before"), F.coalesce("after", "border_after").alias("after"))

    def run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("host", "lines", "sizes", "before", "after")}
            apart = {}
            for side in ("before", "after"):
                apart[side] = [x is None or x["host"] != host or not near_copy(lines, sizes, x["lines"], x["sizes"]) for host, lines, sizes, x in zip(at["host"], at["lines"], at["sizes"], at[side])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart["before"], pa.bool_()), pa.array(apart["after"], pa.bool_())], [*batch.schema.names, "starts", "stops"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # a struct around the page, as a run at the end of its host has no page there, which is not the same as no end
    rows = rows.mapInArrow(run_ends, f"{schema}, starts boolean, stops boolean")
    rows = rows.withColumn("before", F.when(F.col("starts"), F.struct(F.col("before").alias("page")))).withColumn("after", F.when(F.col("stops"), F.struct(F.col("after").alias("page"))))
    rows = scratch.keep(rows.drop("starts", "stops"), "runs")
    place = F.struct("host", "path", "tie")
    carried = rows.groupBy("part").agg(F.max_by("before", F.when(F.col("before").isNotNull(), place)).alias("before"), F.min_by("after", F.when(F.col("after").isNotNull(), place)).alias("after"))
    carried = carried.select("part", F.last("before", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"), F.last("after", True).over(order_back.rowsBetween(Window.unboundedPreceding, -1)).alias("from_after"))
    rows = rows.withColumn("before", F.last("before", True).over(own.rowsBetween(*so_far))).withColumn("after", F.last("after", True).over(back.rowsBetween(*so_far)))
    rows = rows.join(carried, "part").select("tie", "host", "path", "lines", "sizes", F.coalesce("before", "from_before")["page"].alias("before"), F.coalesce("after", "from_after")["page"].alias("after"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ties, found = [], []
            for tie, host, path, lines, sizes, before, after in zip(*[c.to_pylist() for c in batch.columns]):
                # the ends of a run may differ from each other, and one of them be a copy of this page all the same
                near = [(common_start(path, x["path"]), i, x["lines"]) for i, x in ((1, before), (0, after)) if x is not None and x["host"] == host and not near_copy(lines, sizes, x["lines"], x["sizes"])]
                if near and lines:
                    gone = common_lines(lines, max(near, key=lambda x: x[:2])[2])
                    if gone:
                        ties.append(tie)
                        found.append(sorted(gone))
            if ties:
                yield pa.RecordBatch.from_arrays([pa.array(ties, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["tie", "gone"])

    return rows.mapInArrow(shared, "tie long, gone array<int>")


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)
