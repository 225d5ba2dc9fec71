"""Main text of web pages: page structure first, then sparse suffix arrays per host over open and article blocks.

Each page is cut into blocks by its markup. A block inside an article is content; one inside a menu, header, footer,
sidebar or form element, or hidden, is chrome; the rest is open. No element or class makes chrome of what holds or
encloses an article: a form around it is a wrapper, an article within a menu or sidebar is content where the page has no
other, and the header of an article belongs to it. A class, id or role that names a sidebar, notice, advert or the like
makes chrome only beside content; within an article it does so only as the noun of its name (``reader-comments``, not
``share-price``); on a page without an article such blocks are open.

Open blocks are decided by repeats on the host. Equal blocks are collapsed to one row first: what several pages have is
repeated as a whole. The streams of the distinct blocks outside articles, their tokens tied to the host, then go
through a suffix array that keeps suffixes at minimisers only: sorted by their first tokens, neighbours compared, matches
extended left and right window by window (the steps of ``suffix_dedup``). A block mostly covered by substrings of
``run`` tokens that another page of the host has is boilerplate; blocks with unique runs stay. Exact copies of a page
count as one. Where a page has no article and everything open on it repeats, its open blocks stay.

Blocks of articles are never removed for what articles share: articles that quote each other or are copied are main
text. They pass through a second suffix array with the host's furniture, the repeated blocks outside articles, and one
goes where substrings of the furniture cover it mostly and it is no article's own: it stands, as a whole, in more than
one and in over ``common`` of the host's different articles (different: by their longest block), and not at the start.
Every article block is compared; those without enough runs in the furniture, which a bitmap of fixed size tells without
missing one, cannot be covered by it and leave no suffix.

Defined cases. Null html: empty text. Null url: the pages without one share a host. Repeated rows: each its own.
Pages of any length are read whole; unclosed tags close with their parent or the page. Empty table: empty result.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetrace.llm.common import named
from pulsetrace.llm.suffix_dedup import Passages, mixed, powers, shared, union_of
from pulsetrace.session import materialise


@dataclass(frozen=True)
class Extraction:
    """``run``: least tokens of a repeated substring; ``gram``: tokens that suffixes are sorted by; ``covered``: share
    of a block's tokens above which it goes; ``common``: share of a host's different articles that an article block must
    stand in, to go."""

    run: int = 6
    gram: int = 3
    covered: float = 0.5
    common: float = 0.5


CONTENT, OPEN, CHROME, MARKED, NESTED, HIDDEN = range(6)
# Element names of the HTML standard by what they mean here.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object",
       "canvas", "audio", "video", "head")
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
#: Of these, the ones that are wrappers where they enclose an article.
WRAPPERS = {"form", "dialog", "button"}
CONTENT_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = CHROME_TAGS | CONTENT_TAGS | HEADINGS | {
    "div", "section", "ul", "ol", "dl", "table", "figure", "details", "center", "body", "span", "p", "li", "td", "a"}
BLOCKS = CHROME_TAGS | CONTENT_TAGS | HEADINGS | {
    "html", "body", "div", "section", "p", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr",
    "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "hr", "address", "details", "summary", "center",
    "hgroup", "option", "optgroup", "legend", "fieldset"} - {"button"}
#: Elements that a following block element closes, so that they never enclose one.
SHORT = {"p", "li", "td", "span", "a", *HEADINGS}
#: Words in a class, id or role that suggest chrome.
CHROME_WORDS = set("""
    ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert alerts notification sidebar sidebars side aside nav navbar navigation menu menus breadcrumb
    breadcrumbs footer header masthead topbar toolbar comment comments disqus reply replies respond share sharing social
    related recommended newsletter subscribe subscription signup login popup modal overlay dialog search searchform
    pagination pager widget widgets skip contentinfo complementary form hidden copyright paywall
""".split())
#: Words after which the one before is the noun of a compound name.
PARTS = set("area bar block box button buttons container content form group inner item items links list outer section wrap wrapper".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<!/)>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def names_chrome(value: str, within: bool) -> bool:
    """Whether a class, id or role suggests chrome: by any of its words, within an article by its nouns."""
    if not within:
        return not CHROME_WORDS.isdisjoint(re.split(r"[^a-z]+", value))
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        while len(words) > 1 and words[-1] in PARTS and words[-1] not in CHROME_WORDS:
            words.pop()
        if words and words[-1] in CHROME_WORDS:
            return True
    return False


def marked(attrs: str, within: bool = False) -> int:
    """HIDDEN where an element's attributes hide it, MARKED where a name in them suggests chrome, else OPEN."""
    found = OPEN
    for match in ATTRIBUTE.finditer(attrs):
        name, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return HIDDEN
        if name in ("class", "id", "role") and names_chrome(value, within):
            found = MARKED
    return found


def role_of(within: Iterable[list]) -> int:
    """Role of a block from the containers around it, outermost first."""
    kinds = [kind for _, kind in within]
    if HIDDEN in kinds:
        return CHROME
    if CONTENT not in kinds:
        return next((k for k in (CHROME, MARKED) if k in kinds), OPEN)
    first = kinds.index(CONTENT)
    inside = kinds[first + 1:]
    if CHROME in inside or MARKED in inside:
        return CHROME if CHROME in inside else MARKED
    return NESTED if CHROME in kinds[:first] else CONTENT


def parts_of(page: str) -> list[tuple[str, int]]:
    """(text, role) of a page's blocks in order, blank ones left out. A class, id or role word alone makes a block MARKED;
    on body, main, article and whatever encloses the outermost article or main it says nothing."""
    out: list[tuple[str, tuple[list, ...]]] = []
    stack: list[list] = []  # open containers: name and what they make of their content, -1 for nothing
    parts: list[str] = []
    role, state, last = OPEN, (), 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, state))
            parts.clear()

    for match in TOKEN.finditer(page):
        if match.start() > last:
            parts.append(page[last: match.start()])
        last = match.end()
        tag = match["tag"]
        if tag is None:
            if match["raw"] and match["raw"].lower() == "head":
                flush()
            continue
        tag, closing, attrs = tag.lower(), bool(match["close"]), match["attrs"]
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            while not closing and stack and stack[-1][0] in SHORT and (
                    tag == stack[-1][0] or tag not in SHORT - {"p", *HEADINGS}):
                stack.pop()
            role, state = role_of(stack), tuple(stack)
        if tag in CONTAINERS:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif not attrs.endswith("/"):
                kind, within = -1, any(k == CONTENT for _, k in stack)
                if tag in CONTENT_TAGS:
                    kind = CONTENT
                    for entry in stack:
                        if entry[1] == CONTENT:
                            break
                        if entry[1] == MARKED or entry[1] == CHROME and entry[0] in WRAPPERS:
                            entry[1] = -1
                says = marked(attrs, within) if attrs else OPEN
                if says == HIDDEN:
                    kind = HIDDEN
                elif tag in CHROME_TAGS and not (tag == "header" and within):
                    kind = CHROME
                elif says == MARKED and tag != "body" and tag not in CONTENT_TAGS:
                    kind = MARKED
                if tag in SHORT and kind not in (CHROME, MARKED, HIDDEN) and tag not in HEADINGS:
                    continue
                if parts and kind in (CHROME, MARKED, HIDDEN):
                    flush()
                stack.append([tag, kind])
            kinds = role_of(stack)
            if kinds != role and parts:
                flush()
            role, state = kinds, tuple(stack)
    if last < len(page):
        parts.append(page[last:])
    flush()
    return [(text, role_of(within)) for text, within in out]


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, role) as the markup alone has it: whatever it marks is chrome."""
    return [(text, CHROME if role == MARKED else role) for text, role in parts_of(page)]


def settled(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Articles within chrome are content where there is no other; marked blocks beside content are chrome, on a page
    without content they are open like the others."""
    roles = {role for _, role in found}
    nested = CHROME if CONTENT in roles else CONTENT
    beside = CHROME if roles & {CONTENT, NESTED} else OPEN
    return [(text, nested if r == NESTED else beside if r == MARKED else r) for text, r in found]


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower().rpartition("@")[2]


def parse(pages: DataFrame) -> DataFrame:
    """row key, page_id, url, host and blocks of every page, as a table.

    ``article``: the blocks of articles; ``rest``: the others with their roles; both with their places on the page.
    ``print`` tells the whole text, ``core`` the article by its longest block, null where there is none.
    """
    place, role = [("at", pa.int32()), ("text", pa.string())], [("role", pa.int32())]
    kinds = [pa.list_(pa.struct(place)), pa.list_(pa.struct(place + role))]

    def mark(text: str) -> int:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [settled(parts_of(h or "")) for h in batch.column(2).to_pylist()]
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            article = [[{"at": i, "text": t} for i, (t, r) in enumerate(f) if r == CONTENT] for f in found]
            rest = [[{"at": i, "text": t, "role": r} for i, (t, r) in enumerate(f) if r != CONTENT] for f in found]
            prints = [mark("\n".join(t for t, _ in f)) for f in found]
            cores = [mark(max((b["text"] for b in a), key=lambda t: (len(t), t))) if a else None for a in article]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(prints, pa.int64()),
                 pa.array(cores, pa.int64()), pa.array(article, kinds[0]), pa.array(rest, kinds[1])],
                names=["page_id", "url", "host", "print", "core", "article", "rest"])

    slim = pages.select(named("page_id").cast("long").alias("page_id"), named("url").cast("string").alias("url"),
                        named("html").cast("string").alias("html"))
    parsed = slim.mapInArrow(run, "page_id long, url string, host string, print long, core long, "
                                  "article array<struct<at:int,text:string>>, rest array<struct<at:int,text:string,role:int>>")
    return materialise(parsed.withColumn("row", F.monotonically_increasing_id()))


def distinct_blocks(parsed: DataFrame) -> DataFrame:
    """block, host, text, and smallest and largest page signature of every different block of a host outside articles."""
    every = parsed.select("host", "print", F.explode("rest").alias("b")).select(
        "host", "print", F.col("b.text").alias("text"), F.xxhash64("host", "b.text").alias("block"))
    return every.groupBy("block").agg(F.first("host").alias("host"), F.first("text").alias("text"),
                                      F.min("print").alias("lo"), F.max("print").alias("hi"))


def tied(blocks: DataFrame) -> DataFrame:
    """block, doc_id and text for the suffix array: tokens prefixed by their host's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tie = f"{xxhash.xxh32_hexdigest(host.encode('utf-8', 'surrogatepass'))}:"
                texts.append(" ".join([tie + t for t in text.split(" ")]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["block", "doc_id", "text"])

    return blocks.select("block", "doc_id", "host", "text").mapInArrow(run, "block long, doc_id long, text string")


def mostly_shared(blocks: DataFrame, settings: Extraction) -> DataFrame:
    """block and doc_id of the blocks that substrings of other doc_ids of their host cover in more than ``covered``."""
    streams = materialise(tied(blocks))
    texts, intervals = shared(streams, Passages(min_words=settings.run, gram=settings.gram))
    found = intervals.distinct().groupBy("doc", "mark").agg(
        F.collect_list(F.struct("lo", "hi")).alias("found")).join(texts, ["doc", "mark"])
    covered = F.aggregate(union_of("found", "lo", "hi"), F.lit(0).cast("long"), lambda a, x: a + x.hi - x.lo)
    mostly = found.where(covered > settings.covered * F.col("n_words")).select(
        F.col("doc").alias("doc_id"), F.col("mark").alias("mark"))
    return streams.select("block", "doc_id", F.xxhash64("text").alias("mark")).join(mostly, ["doc_id", "mark"]).select("block", "doc_id")


def boilerplate(parsed: DataFrame, settings: Extraction = Extraction()) -> DataFrame:
    """block, host and text of the blocks outside articles that other pages of their host have, as a whole or in more
    than ``covered`` of their tokens.

    A block of one page counts as that page, a repeated one as a page of its own, so that either differs from every other
    page that has part of it.
    """
    blocks = materialise(distinct_blocks(parsed))
    page = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-F.shiftrightunsigned("block", 1) - 1)
    partly = mostly_shared(blocks.withColumn("doc_id", page), settings)
    return blocks.where("lo < hi").union(blocks.where("lo = hi").join(partly, "block", "left_semi")).select("block", "host", "text")


#: Bits of the bitmap of the furniture's runs, 8 MB. With many more runs it lets blocks pass that the suffix array rejects.
BITS = 1 << 26
#: Bits of one row of Spark's bitmap functions.
ROW = 1 << 15
#: Characters of the blocks that are compared with the bitmap at a time.
PIECE = 1 << 20


def pieces(hosts: list[str], texts: list[str]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(number of the first block, hosts, texts) of blocks of about ``PIECE`` characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size > PIECE:
            yield first, hosts[first:i], texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, hosts[first:], texts[first:]


def places_of(hosts: list[str], texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the bitmap and first token of every run of so many tokens within a block; block of every token.

    A run is told by a polynomial hash of its bytes, tied to its host.
    """
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    blank = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.append(0, blank + 1), np.append(blank, len(data))
    block = np.cumsum(np.append(0, data[blank] == 10))
    count = max(0, len(starts) - run + 1)
    tokens = np.flatnonzero(block[:count] == block[len(block) - count:])
    lo, hi = starts[tokens], ends[tokens + run - 1]
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * up[:-1], dtype=np.uint64)])
    found = (sums[hi] - sums[lo]) * down[lo]
    ties = {h: xxhash.xxh64_intdigest(h.encode("utf-8", "surrogatepass")) for h in set(hosts)}
    found = mixed(found) ^ np.array([ties[h] for h in hosts], np.uint64)[block[tokens]]
    return (found & np.uint64(BITS - 1)).astype(np.int64), tokens, block


def bitmap_of(blocks: DataFrame, run: int) -> np.ndarray:
    """Bitmap, ``BITS`` in all, of the places of all runs of the blocks."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hosts, texts in pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(places_of(hosts, texts, run)[0])], names=["place"])

    place = blocks.select("host", "text").mapInArrow(places, "place long")
    rows = place.groupBy((F.col("place") / ROW).cast("int").alias("at")).agg(
        F.bitmap_construct_agg(F.col("place") % ROW).alias("bits")).collect()  # at most BITS / ROW
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[r["at"] * (ROW // 8): (r["at"] + 1) * (ROW // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def likely(parsed: DataFrame, furniture: DataFrame, settings: Extraction) -> DataFrame:
    """row, at, host, core, text and whether it is the first of every article block that runs in the furniture's
    bitmap cover in more than ``covered`` of its tokens."""
    bits, run, least = bitmap_of(furniture, settings.run), settings.run, settings.covered

    def covered(hosts: list[str], texts: list[str]) -> np.ndarray:
        at, tokens, block = places_of(hosts, texts, run)
        hits = tokens[np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)]
        step = np.zeros(len(block) + 1, np.int64)
        step[hits] += 1
        step[hits + run] -= 1
        inside = np.cumsum(step[:-1]) > 0
        return np.flatnonzero(np.bincount(block, inside) > least * np.bincount(block))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = list(zip(*(c.to_pylist() for c in batch.columns[:3])))
            of = np.repeat(np.arange(len(pages)), pc.list_value_length(batch.column(3)).to_numpy())
            article = batch.column(3).flatten()
            places, texts = article.field("at"), article.field("text").to_pylist()
            found = [first + i for first, *piece in pieces([pages[i][1] for i in of], texts) for i in covered(*piece)]
            if found:
                rows = [(*pages[of[i]], places[int(i)].as_py(), texts[i], i == 0 or of[i] != of[i - 1]) for i in found]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["row", "host", "core", "at", "text", "first"])

    return parsed.select("row", "host", "core", "article").mapInArrow(
        find, "row long, host string, core long, at int, text string, first boolean")


def template_lines(parsed: DataFrame, furniture: DataFrame, settings: Extraction = Extraction()) -> DataFrame:
    """row and place of the article blocks that are furniture of their host.

    In their suffix array the furniture counts as one page and the articles as another: what only articles share is not
    shared there.
    """
    every = materialise(likely(parsed, furniture, settings).withColumn("block", F.xxhash64("host", "text")))
    blocks = materialise(every.groupBy("block").agg(
        F.first("host").alias("host"), F.first("text").alias("text"), F.countDistinct("core").alias("n")))
    sides = blocks.select("block", F.lit(1).cast("long").alias("doc_id"), "host", "text").union(
        furniture.select("block", F.lit(0).cast("long"), "host", "text"))
    covered = mostly_shared(sides, settings).where("doc_id = 1")
    articles = materialise(parsed.groupBy("host").agg(F.countDistinct("core").alias("articles")))
    # Small unless most pages have such blocks: a table of known size, so that no line of many pages lands in one task.
    gone = materialise(blocks.join(covered, "block", "left_semi").join(articles, "host").where(
        (F.col("n") > 1) & (F.col("n") > settings.common * F.col("articles"))).select("block"))
    return every.where("NOT first").join(gone, "block", "left_semi").select("row", "at")


def extract(pages: DataFrame, settings: Extraction = Extraction()) -> DataFrame:
    """page_id, url and text of every page."""
    parsed = parse(pages)
    furniture = materialise(boilerplate(parsed, settings))
    lines = materialise(template_lines(parsed, furniture, settings))
    asked = parsed.select("row", "host", F.explode(F.filter("rest", lambda b: b.role == OPEN)).alias("b")).select(
        "row", F.col("b.at").alias("at"), F.xxhash64("host", "b.text").alias("block"))
    repeated = asked.join(furniture, "block", "left_semi").select("row", "at")

    def text(article: list[dict], open_: list[dict], gone: list[int] | None) -> str:
        drop = set(gone or ())
        kept = [b for b in (*article, *open_) if b["at"] not in drop] or open_
        return "\n".join(b["text"] for b in sorted(kept, key=lambda b: b["at"]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    def without(pages: DataFrame, blocks: DataFrame) -> DataFrame:
        gone = materialise(blocks.groupBy(F.col("row").alias("of")).agg(F.collect_set("at").alias("gone")))  # at most the page's own
        return pages.join(gone, F.col("row") == F.col("of"), "left").select(
            "page_id", "url", "article", F.filter("rest", lambda b: b.role == OPEN).alias("open"), "gone").mapInArrow(
            finish, "page_id long, url string, text string")

    # Apart, as most open blocks go and few of articles: pages of articles only then need not move to their lines.
    any_open = F.exists("rest", lambda b: b.role == OPEN)
    return without(parsed.where(any_open), repeated.union(lines)).union(without(parsed.where(~any_open), lines))
