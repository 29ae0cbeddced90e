"""Operator 8: main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path, and each is paired with the neighbour in its host whose path
shares the longer start with its own. The text lines of both pages are aligned by a longest common
subsequence; lines that the two share come from the site's template and are deleted.

The page's own structure is respected on top of that: markup that never holds the article (scripts,
styles, menus, forms, asides, footers, comments of readers, adverts and notices by class, id or role) is
left out. Where a page declares its article (article, main, role=main, articleBody, a content container)
and this holds most of the page's own text, the article is what is inside; else (cards of other articles
around a body in a plain container) everything that is left counts.

Differencing decides inside the article too, but two pages of a host may carry the same article or quote
the same passage. So a shared line goes there only if it is host-wide: on at least three different pages
of its host and on more than half of them. Pages of equal text are copies and count once; the neighbour is
the next page that is no copy. If a neighbour shares more than half of the page's text outside host-wide
lines, it is a near copy: then the neighbour on the other side serves, and if there is none, only host-wide
lines go. A host of one or two different pages has no host-wide lines; there the neighbour alone decides.

A host has at most two times as many host-wide lines as its pages have lines on average, so they are dealt
to the blocks of the host's pages, whatever the host's size. Lines are compared by 64-bit hashes.

Defined results: null or empty html gives ""; a page that is alone in its host is judged by structure; broken
markup never fails (unclosed elements end with their parents); repeated rows give repeated results.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import block_numbers, discard, spark_of, stage

DROP, OTHER, MAIN = 0, 1, 2
BLOCK_ROWS = 32_768  # pages of a block of neighbouring keys
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav aside footer form button select option menu dialog iframe object canvas svg math map audio video head title "
                  "fieldset datalist".split())
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|xmp)\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
                 r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
# quoted values may hold ">"; nothing is tried twice, and a tag that a quote leaves open has an empty last group
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)")
OPEN_TAG = re.compile(r"</?[a-zA-Z]")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(>)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|site-?header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|"
    r"respond|share|sharing|social|related|recommend\w*|subscribe|subscription|newsletter|signup|login|pagination|pager|search|skip-link|"
    r"contentinfo|complementary|search|dialog)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|\s)(?:main|content|main-?content|article-?(?:body|content|text)|post-?(?:body|content)|entry-?(?:body|content)|story-?body)(?:$|\s)",
                     re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def tags(s: str):
    """Matches of the page's tags, in one pass over the text. Where a quote is left open to the end of the page, that tag and all after it end at
    their first ">", whatever quotes they hold."""
    pattern, at, end = TAG, 0, s.rfind(">") + 1
    while m := pattern.search(s, at, end):
        if m.group(4):
            yield m
            at = m.end()
        else:
            pattern, at = PLAIN_TAG, m.start()


def page_lines(source: str) -> list[tuple[str, int]]:
    """Text lines in page order with the region each stands in (DROP, OTHER or MAIN)."""
    if not source:
        return []
    s = RAW.sub(" ", source)
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    region = OTHER
    buf: list[str] = []

    def flush():
        if buf:
            t = "".join(buf)
            buf.clear()
            t = " ".join((html_lib.unescape(t) if "&" in t else t).split())
            if t:
                lines.append((t, region))

    at, opened = 0, Counter()
    for m in tags(s):
        a, b = m.span()
        if a > at:
            buf.append(s[at:a])
        at = b
        close, name, attrs, _ = m.groups()
        name = name.lower()
        if name in VOID:
            if name == "br" or name == "hr":
                flush()
            continue
        inline = name in INLINE
        if close:
            k = len(stack) - 1 if opened[name] else -1
            while k >= 0 and stack[k][0] != name:
                k -= 1
            if not inline:
                flush()
            if k >= 0:
                if inline:
                    flush()
                region = stack[k][1]
                opened.subtract(t for t, _ in stack[k:])
                del stack[k:]
            continue
        mark = " ".join(filter(None, (x for t in NAMED.findall(attrs) for x in t))) if attrs else ""
        kind = None
        if region != DROP:
            if name in NEVER or (name == "header" and region != MAIN) or (mark and name not in ("html", "body") and BOILER.search(mark)
                                                                        and not CONTENT.search(mark)) or (attrs and HIDDEN.search(attrs)):
                kind = DROP
            elif name in ("article", "main") or (mark and CONTENT.search(mark)) or "articlebody" in attrs.lower():
                kind = MAIN
        if inline and kind is None:
            continue
        flush()
        if name in ("p", "li", "dt", "dd", "tr", "td", "th"):  # these end where the next one starts
            if stack and stack[-1][0] == name:
                region = stack.pop()[1]
                opened[name] -= 1
                if kind is None and region != DROP and (attrs and mark and BOILER.search(mark)):
                    kind = DROP
            if kind is None and name != "li":
                if name == "p":
                    continue
        elif stack and stack[-1][0] == "p":
            region = stack.pop()[1]
            opened["p"] -= 1
        if attrs.endswith("/"):
            continue
        stack.append((name, region))
        opened[name] += 1
        if kind is not None:
            region = kind
    rest = OPEN_TAG.search(s, at)  # the page may end inside a tag
    buf.append(s[at:rest.start()] if rest else s[at:])
    flush()
    return lines


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of lines with ``b``. Equal ends are taken off
    first; the middle is a longest rising run of matches (only places where lines match are visited)."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(a) - hi, len(a)))
    where: dict = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node is not None:
        out.add(node[0])
        node = node[1]
    return out


def main_text(lines: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """Main text of a page against one neighbour, without knowledge of the host."""
    ids: dict[str, int] = {}
    page, other = (([t for t, r in x if r != DROP], [ids.setdefault(t, len(ids)) for t, r in x if r != DROP], [r for _, r in x if r != DROP])
                   for x in (lines, neighbour or []))
    return judged(page, [other] if neighbour else [], frozenset(), False)


def judged(page: tuple, neighbours: list[tuple], host_wide, known: bool) -> str:
    """Main text of ``page`` (texts, hashes, regions) against its neighbours, the nearest first. ``known``:
    the host has enough pages to tell its host-wide lines."""
    texts, ids, regions = page
    n = range(len(texts))
    wide = {i for i in n if ids[i] in host_wide}
    own = sum(len(texts[i]) for i in n if i not in wide)
    shared: set[int] = set()  # with any neighbour: here host-wide lines go
    gone: set[int] = set()
    for other in neighbours:
        met = shared_lines(ids, other[1])
        shared |= met
        if known:
            copy = 2 * sum(len(texts[i]) for i in met - wide) > own
        else:
            copy = len(met) == len(texts)
        if not copy:
            gone = met
            break
    sure = shared & wide
    left = sum(len(texts[i]) for i in n if i not in gone and i not in sure)
    main = [i for i in n if regions[i] == MAIN and i not in sure]
    if main and 2 * sum(len(texts[i]) for i in main) >= left:
        return " ".join(texts[i] for i in main)
    return " ".join(texts[i] for i in n if i not in gone and i not in sure)


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def line_hash(host: str, line: str) -> int:
    return int.from_bytes(blake2b(f"{host}\0{line}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parse(batches):
    """Lines of every page outside DROP, with their hashes and regions; the key ends in the hash of them all."""
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = []
            for p, u, h, host, path, pid in zip(*(part.column(c).to_pylist() for c in range(6)), strict=True):
                lines = [x for x in page_lines(h) if x[1] != DROP]
                texts, ids = [t for t, _ in lines], [line_hash(host, t) for t, _ in lines]
                regions = bytes(r for _, r in lines)
                sig = blake2b(np.array(ids, dtype=np.int64).tobytes() + regions + host.encode(), digest_size=8).digest()
                same = int.from_bytes(sig, "little", signed=True)
                rows.append((p, u, f"{host}\t{path}\t{pid}\t{sig.hex()}", line_hash(host, ""), same, texts, ids, regions))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["page_id", "url", "_key", "_host", "_same", "lines", "ids", "regions"])


def _host_wide(parsed: DataFrame) -> DataFrame:
    """(_host, line) of the host-wide lines; a host's own hash stands for the empty line that each of its pages
    has, so it is among them if the host has three different pages."""
    pages = parsed.where(~F.col("_key").startswith("\t")).select("_host", "_same", "ids").withColumn(
        "line", F.explode(F.array_distinct(F.concat("ids", F.array("_host")))))
    n = pages.groupBy("_host", "line", "_same").agg(F.lit(1).alias("x")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n"))
    n = n.where("n >= 3")
    every = n.groupBy("_host").agg(F.max("n").alias("of"))
    return n.join(every, "_host").where("2 * n > of").select("_host", "line")


def blocks_of_unlike(facts: DataFrame, key: str, same: str, rows, sides) -> DataFrame:
    """Deal rows into blocks of neighbouring keys so that every row meets, in its own block, the nearest rows before
    and after it that differ from it in ``same`` (which the key determines). ``facts`` holds key and ``same`` of every row;
    ``rows(None)`` gives the rows with all columns that are to be dealt, ``rows(keys)`` those of a few keys. Returns the rows with

    * ``_block``: number of the block,
    * ``_role``: 0 for the nearest row before the block that differs from its first (a copy), 1 for the block's own rows,
      2 for the nearest row after it that differs from its last (a copy),

    dealt by block and sorted by block, role and key. ``sides`` makes more rows of the same columns from the dealt
    facts, to be dealt to the blocks with them. Blocks hold about ``BLOCK_ROWS`` rows, or fewer where shuffle partitions abound."""
    spark = facts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(4 * parts, math.ceil(facts.count() / BLOCK_ROWS))
    number = block_numbers(facts, key, blocks)
    d = facts.withColumn("_block", number(key))
    small = d.select("_block", F.col(key).alias("k"), F.col(same).alias("s"))
    ends = small.groupBy("_block").agg(F.max("k").alias("hi"), F.min("k").alias("lo"), F.max_by("s", "k").alias("hs"), F.min_by("s", "k").alias("ls")) \
        .orderBy("_block").collect()
    extra = []
    if ends:  # one row per block: small by construction
        e = F.broadcast(spark.createDataFrame([(r["_block"], r["ls"], r["hs"]) for r in ends], f"_block long, ls {dict(facts.dtypes)[same]}, hs {dict(facts.dtypes)[same]}"))
        inner = {r["_block"]: r for r in small.join(e, "_block").groupBy("_block").agg(
            F.max(F.expr("CASE WHEN s <> hs THEN k END")).alias("hi"), F.min(F.expr("CASE WHEN s <> ls THEN k END")).alias("lo")).collect()}
        # the last row that differs, block by block: (key, its block, same) of the last row and of the last one unlike it
        for role, order, at, end, first in ((0, ends, "hi", "hs", "ls"), (2, ends[::-1], "lo", "ls", "hs")):
            last = other = None
            for r in order:
                b = r["_block"]
                if last is not None:
                    near = last if last[2] != r[first] else other
                    if near is not None:
                        extra.append((near[0], near[1], b, role))
                if inner[b][at] is not None:
                    other = (inner[b][at], b)
                elif last is not None and last[2] != r[end]:
                    other = last[:2]
                last = (r[at], b, r[end])
    out = rows(None).withColumn("_block", number(key)).withColumn("_role", F.lit(1))
    if extra:  # two rows per block at most
        copies = F.broadcast(spark.createDataFrame(extra, f"_ob_key {dict(facts.dtypes)[key]}, _from long, _to long, _role2 int"))
        few = rows([e[0] for e in extra]).withColumn("_block", number(key))
        moved = few.join(copies, (F.col(key) == F.col("_ob_key")) & (F.col("_block") == F.col("_from")))
        moved = moved.withColumn("_block", F.col("_to")).withColumn("_role", F.col("_role2")).drop("_ob_key", "_from", "_to", "_role2")
        out = out.unionByName(moved.select(*out.columns))
    return out.unionByName(sides(d)).repartition(max(parts, blocks // 4), "_block").sortWithinPartitions("_block", "_role", key)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    import pyarrow as pa

    spark = spark_of(pages)
    u = F.lower(F.coalesce(F.col(url).cast("string"), F.lit("")))
    host = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(u, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
                       F.translate(host, "\t", " ").alias("host"), F.translate(path, "\t", " ").alias("path"),
                       F.lpad(F.coalesce(F.col(page_id).cast("string"), F.lit("")), 20, "0").alias("pid"))
    schema = "page_id long, url string, _key string, _host long, _same long, lines array<string>, ids array<long>, regions binary"
    # pages are parsed where their facts are staged and again where their lines are dealt, so that the lines lie on disk once
    hashed = stage(src.mapInArrow(_parse, schema).select("_key", "_host", "_same", "ids"), "pages-ids")
    wide = stage(_host_wide(hashed), "pages-wide")
    facts = stage(hashed.select("_key", "_host", "_same"), "pages-facts")
    discard(hashed)

    def rows_of(keys: list[str] | None) -> DataFrame:
        """The pages' lines; of the keys named alone, if any are: their ids stand in the key."""
        some = src if keys is None else src.join(F.broadcast(spark.createDataFrame([(p,) for p in sorted({k.split("\t")[2] for k in keys})], "pid string")), "pid", "left_semi")
        return some.select(*src.columns).mapInArrow(_parse, schema).select("page_id", "url", "_key", "lines", "regions")

    def of_blocks(d: DataFrame) -> DataFrame:
        here = d.select("_host", "_block").distinct().join(wide, "_host")
        return here.select(F.col("line").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("").alias("_key"),
                           F.lit(None).cast("array<string>").alias("lines"), F.lit(None).cast("binary").alias("regions"), "_block", F.lit(-1).alias("_role"))

    dealt = blocks_of_unlike(facts, "_key", "_same", rows_of, of_blocks)

    def run(batches):
        rows: list[tuple] = []
        block, host_wide = None, set()
        before = None  # (host, path, page) of the last page that is no copy of the run
        held: list[tuple] = []  # own rows of the run of copies: page_id, url, path
        here = None  # (key's sig, host, path, page) of the run

        def emit(after):
            if not held:
                return
            texts: dict = {}
            host, page = here[1], here[3]
            known = host != "" and line_hash(host, "") in host_wide
            near = [x for x in (before, after) if x is not None and x[1] == host and host]
            for p, u0, at in held:
                order = tuple(sorted(range(len(near)), key=lambda k: -common_start(near[k][2], at)))
                if order not in texts:
                    texts[order] = judged(page, [near[k][3] for k in order], host_wide, known)
                rows.append((p, u0, texts[order], len(texts[order])))
            held.clear()

        def out():
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            b = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                           names=["page_id", "url", "text", "n_chars"])
            rows.clear()
            return b

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for p, u0, key, lines, regions, b, role in zip(*(part.column(c).to_pylist() for c in range(7)), strict=True):
                    if b != block:
                        emit(None)
                        block, host_wide, before, here = b, set(), None, None
                    if role == -1:
                        host_wide.add(p)  # such a row carries the line's hash
                        continue
                    k = key.split("\t")
                    if here is None or (here[0], here[1]) != (k[3], k[0]):
                        page = (k[3], k[0], k[1], (lines, [line_hash(k[0], t) for t in lines], regions))
                        emit(page)
                        before, here = here, page
                    if role == 1:
                        held.append((p, u0, k[1]))
                    here = (here[0], here[1], k[1], here[3])
                if len(rows) >= 256:
                    yield out()
        emit(None)
        if rows:
            yield out()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
