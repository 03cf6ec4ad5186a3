"""Main text of HTML pages: host suffix arrays over every page, checked against its markup.

Parsing cuts a page into blocks. Blocks inside ``article`` or ``main`` are the text; menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are told by element, role, class and id.
Boilerplate is what a host repeats. The token streams of all blocks outside the text are concatenated over the pages
of a host, for every host, their suffixes are sorted, and substrings of ``LONG`` or more tokens that occur on ``PAGES`` or
more distinct pages are repeated. Every page is then held against them. Pages without ``article`` and
``main`` leave blocks open: these lose their covered tokens and keep their unique runs. Blocks inside an article are
never removed for being repeated, as articles share passages, also with adverts and footers; ``n_repeated``
tells how many words of the text repeated substrings cover.

Equal streams are sorted once and weigh as many pages as hold them. A host with more than ``SHARD`` distinct
streams is dealt into several suffix arrays by a hash of the stream, so no task holds more than that on average; the
arrays give out how many pages hold each substring of ``LONG`` tokens, and these counts are added up per host, so
evidence is the whole host whatever its size.

Defined cases: a null or empty html gives an empty text; pages without a host are one host; pages with the same whole html count once as evidence; repeated rows and null ids are kept; documents that
end early are read as far as they go; other columns do not take part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import written

SHARD = 512
LONG = 8
PAGES = 3
#: Bits of the map of repeated substrings that texts are first held against.
BITS = 1 << 26
_MAP_BITS = 32768  # bits of one bitmap that Spark builds
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# What starts like a tag and has no end is text up to where that shows, so broken markup is read in linear time.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>]+)*+)(?P<end>>?)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# fixed values: elements of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea iframe title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "tfoot thead tr ul".split()
)
SPACES = frozenset("br td th option".split())
TEXT = frozenset(("article", "main"))
AROUND = frozenset(
    "aside audio button canvas datalist dialog footer form head menu nav object search select svg template video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disqus disclaimer footer form gdpr login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
HEADERS = frozenset(("header", "topbar"))
#: Words that stand beside a name without changing what the element holds.
COMPANIONS = frozenset(
    "area article articles bar block blog body bottom box btn button buttons center column container content cta desktop "
    "entry field full global group holder icon icons inline inner input item items left link links list main message "
    "mobile module outer page panel post posts primary reader right row section secondary site slot sticky strip text "
    "thread title top unit user wrap wrapper zone".split()
)
#: Names that tell of a page's layout, not of what an element holds: first or last words.
_NEGATED = frozenset("has with without no hide".split())
_LAYOUT = frozenset("closed enabled layout open page".split())
#: Labels that also stand around a whole page, so outside the text they tell nothing.
_NEUTRAL = frozenset(("widget",))
#: Elements whose id is the target of a link and names their topic.
_ANCHORS = frozenset("a dfn dt em figure h1 h2 h3 h4 h5 h6 li p pre span strong table".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in _ATTR.findall(raw)}


def _is_around(name: str, raw: str, in_text: bool) -> bool:
    """Whether an element holds something other than the text of the page.

    Inside the text a class or id has to say so as a whole: ``share-buttons`` does, ``share-price`` does not.
    """
    if name in AROUND or (name == "header" and not in_text):
        return True
    if not raw.strip() or name in ("html", "body"):
        return False
    attrs = _attributes(raw)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if _HIDDEN.search(attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    labels = attrs.get("class", "")
    if name not in _ANCHORS:
        labels = f"{labels} {attrs.get('id', '')}"
    for label in labels.split():
        words = _WORDS.findall(_CAMEL.sub("-", label).lower())
        if name in TEXT:
            if words and NAMES.issuperset(words):  # such as a comment marked up as an article
                return True
        elif in_text:
            if NAMES.intersection(words) and all(w in NAMES or w in COMPANIONS for w in words):
                return True
        elif words and words[0] not in _NEGATED and words[-1] not in _LAYOUT:
            if NAMES.intersection(words) - _NEUTRAL or HEADERS.intersection(words):
                return True
    return False


class _Page:
    """What a page holds, read tag by tag."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.other: list[str] = []
        self.is_open: list[bool] = []
        self.seen_text = False
        self.stack: list[tuple[str, bool, bool]] = []  # element, around the text, inside the text
        self.places: dict[str, list[int]] = {}  # of every open element, by name
        self.blocks: list[int] = []  # places of the open blocks
        self.words: list[str] = []  # of the current block
        self.aside: list[str] = []  # what elements inside the current block cut out of it
        self.around = self.inside = False

    def add(self, text: str) -> None:
        (self.aside if self.around else self.words).append(text)

    def close_block(self) -> None:
        for words, around in ((self.words, False), (self.aside, True)):
            if not words:
                continue
            block = " ".join(unescape("".join(words)).split())
            words.clear()
            if not block:
                continue
            if self.inside and not around:
                self.text.append(block)
            else:
                self.other.append(block)
                self.is_open.append(not around)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        self.around, self.inside = self.stack[-1][1:] if self.stack else (False, False)

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.close_block()
        elif name in SPACES:
            self.add(" ")
        at = self.places.get(name)
        # a stray end of an inline element does not end a block
        if at and (name in BLOCKS or not self.blocks or at[-1] > self.blocks[-1]):
            self.pop_to(at[-1])

    def open(self, name: str, attrs: str) -> None:
        if name in SPACES:
            self.add(" ")
        if name in BLOCKS:
            self.close_block()
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":  # a block ends an open paragraph
                self.pop_to(self.blocks[-1])
        if name in VOID or attrs.endswith("/"):
            return
        self.around = self.around or _is_around(name, attrs, self.inside)
        if name in TEXT and not self.around:
            self.inside = self.seen_text = True
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, self.around, self.inside))


def parse(html: str | None) -> tuple[list[str], list[str], list[bool], bool]:
    """Blocks of the text; the other blocks, and which of those markup leaves open; whether a text element was seen."""
    page, html, at = _Page(), html or "", 0
    while at < len(html):
        tag = _TAG.search(html, at)
        if tag is None:
            page.add(html[at:])
            break
        if tag.start() > at:
            page.add(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if not tag["end"]:
            page.add(tag.group())
        elif tag["close"]:
            page.close(name)
        elif name in RAW:
            if not tag["attrs"].endswith("/"):
                end = _raw_end(name).search(html, at)
                at = end.end() if end else len(html)
        else:
            page.open(name, tag["attrs"])
    page.close_block()
    return page.text, page.other, page.is_open, page.seen_text


@lru_cache(maxsize=None)  # one entry per element of RAW
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^<>]*>", re.I)


def _ranks(tokens: np.ndarray, long: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``long`` tokens, by doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < long:
        step = min(depth, long - depth)
        later = np.zeros(n, dtype=np.int64)
        later[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank


def _counts(rank: np.ndarray, page: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Distinct pages, or the sum of their weights, of every rank."""
    suffixes = np.lexsort((page, rank))  # the suffix array, to that depth; pages in order among equals
    by_rank, by_page = rank[suffixes], page[suffixes]
    new_page = np.ones(len(rank), dtype=np.int64)
    new_page[1:] = (by_rank[1:] != by_rank[:-1]) | (by_page[1:] != by_page[:-1])
    return np.bincount(by_rank, weights=new_page if weight is None else new_page * weight[by_page])


def _cover(n: int, starts: np.ndarray, long: int) -> np.ndarray:
    edges = np.zeros(n + long + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + long, -1)
    return np.cumsum(edges)[:n] > 0


def covered_positions(tokens: np.ndarray, page: np.ndarray, long: int = LONG, pages: int = PAGES) -> np.ndarray:
    """Which positions lie in a substring of ``long`` tokens that ``pages`` distinct pages hold.

    ``tokens`` are numbers, with a number of its own after each page. The suffixes are ranked by doubling
    up to their first ``long`` tokens: longer repeats are chains of such substrings.
    """
    n = len(tokens)
    if n < long:
        return np.zeros(n, dtype=bool)
    rank = _ranks(tokens, long)
    return _cover(n, np.flatnonzero(_counts(rank, page)[rank] >= pages), long)


@lru_cache(maxsize=1 << 18)
def _word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def _keys(host: str, words: list[str]) -> np.ndarray:
    """Keys of all substrings of ``LONG`` tokens on a host."""
    n = max(0, len(words) - LONG + 1)
    own = np.fromiter(map(_word_key, words), np.uint64, len(words))
    keys = np.full(n, _word_key(host), dtype=np.uint64)
    for k in range(LONG):
        keys = keys * _MULTIPLIER + own[k : k + n]
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def _shard_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """``host, piece, pages`` of every substring of ``LONG`` tokens in one shard of a host."""
    words = [stream.split() for stream in rows["stream"]]
    lengths = np.array([len(w) for w in words])
    flat = [w for own in words for w in own]
    codes, vocabulary = pd.factorize(np.array(flat, dtype=object))
    tokens = np.insert(codes, np.cumsum(lengths), len(vocabulary) + np.arange(len(words)))
    page = np.repeat(np.arange(len(words)), lengths + 1)
    rank = _ranks(tokens, LONG)
    pages = _counts(rank, page, rows["pages"].to_numpy())
    to_end = np.concatenate([np.arange(n, -1, -1) for n in lengths])  # tokens from here to the end of the stream
    whole = np.flatnonzero(to_end >= LONG)
    found, at = np.unique(rank[whole], return_index=True)
    starts = whole[at] - page[whole[at]]  # without the ends
    return pd.DataFrame(
        {
            "host": rows["host"].iat[0],
            "piece": _keys(rows["host"].iat[0], flat)[starts],
            "pages": pages[found].astype(np.int64),
        }
    )


def _pieces(hosts: pd.Series, streams: pd.Series) -> pd.Series:
    return pd.Series([_keys(host, stream.split()) for host, stream in zip(hosts, streams)], dtype=object)


def _bitmap(pieces: DataFrame) -> np.ndarray:
    """The map of the pieces; at most ``BITS`` bits reach the driver."""
    at = F.col("piece").bitwiseAND(F.lit(BITS - 1))
    rows = (
        pieces.groupBy(F.floor(at / _MAP_BITS).alias("map"))
        .agg(F.bitmap_construct_agg(at % _MAP_BITS).alias("bits"))
        .toPandas()
    )
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for number, bits in zip(rows["map"], rows["bits"]):
        start = int(number) * (_MAP_BITS // 8)
        out[start : start + _MAP_BITS // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _in_map(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & (BITS - 1)
    return np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def _covered_words(starts: pd.Series) -> pd.Series:
    return pd.Series([int(_cover(max(at) + LONG, np.asarray(at, dtype=np.int64), LONG).sum()) for at in starts], dtype="int64")


def _own_text(sides: pd.Series, opens: pd.Series, starts: pd.Series) -> pd.Series:
    """Open blocks without what the substrings at ``starts`` cover."""
    texts = []
    for side, is_open, at in zip(sides, opens, starts):
        words = [block.split() for block in side]
        covered = _cover(sum(map(len, words)), np.array([] if at is None else at, dtype=np.int64), LONG)
        kept, done = [], 0
        for own, open_block in zip(words, is_open):
            left = [w for w, c in zip(own, covered[done : done + len(own)]) if not c] if open_block else []
            if left:
                kept.append(" ".join(left))
            done += len(own)
        texts.append("\n".join(kept))
    return pd.Series(texts, dtype=object)


def _parsed(html: str):
    @F.pandas_udf("main string, side array<string>, open array<boolean>, has_text boolean")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = [parse(None if pd.isna(h) else h) for h in pages]
            yield pd.DataFrame(
                [("\n".join(text), side, is_open, seen) for text, side, is_open, seen in rows],
                columns=["main", "side", "open", "has_text"],
            )

    return parsed(html)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_repeated`` of every row of ``page_id, url, html``.

    ``n_repeated`` counts the words of the text in substrings that the host repeats outside its texts.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    parsed = pages.select(
        "page_id", "url", host.alias("host"), F.unhex(F.md5("html")).alias("copy"), _parsed("html").alias("p")
    )
    parsed = written(parsed.select("page_id", "url", "host", "copy", "p.*"), "parsed")
    stream = F.array_join("side", "\n")
    parsed = parsed.withColumn("digest", F.unhex(F.md5(stream)))
    parsed = parsed.withColumn("text_digest", F.unhex(F.md5("main")))
    undecided = ~F.col("has_text") & (F.size("side") > 0)
    undecided_pages = parsed.where(undecided)
    decided = parsed.where(~undecided).select("page_id", "url", "host", "text_digest", F.col("main").alias("text"))

    # evidence: the distinct streams of every host, with their numbers of distinct pages
    side = parsed.where(F.size("side") > 0)
    weights = side.select("host", "digest", "copy").distinct().groupBy("host", "digest").agg(
        F.count("*").alias("pages")
    )
    streams = side.groupBy("host", "digest").agg(F.min(stream).alias("stream"))
    large = written(  # at most one host per SHARD streams; broadcast by size alone
        weights.groupBy("host").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")).where("shards > 1"),
        "hosts",
    )
    shard = F.pmod(F.xxhash64("digest"), F.coalesce("shards", F.lit(1)))
    counted = (
        streams.join(weights, ["host", "digest"]).join(large, "host", "left")
        .select("host", shard.alias("shard"), "stream", "pages")
        .groupBy("host", "shard").applyInPandas(_shard_counts, "host string, piece bigint, pages bigint")
    )
    repeated = cut(  # written, so that the join below can split a hot piece
        counted.groupBy("host", "piece").agg(F.sum("pages").alias("pages"))
        .where(F.col("pages") >= PAGES).select("host", "piece")
    )
    starts = (
        undecided_pages.groupBy("host", "digest").agg(F.min(stream).alias("stream"))
        .select("host", "digest", F.posexplode(F.pandas_udf(_pieces, "array<bigint>")("host", "stream")).alias("start", "piece"))
        .join(repeated, ["host", "piece"])
        .groupBy("host", "digest").agg(F.collect_list("start").alias("starts"))  # one entry per token at most
    )
    found = undecided_pages.join(starts, ["host", "digest"], "left").select(
        "page_id", "url", F.pandas_udf(_own_text, "string")("side", "open", "starts").alias("text")
    )
    # texts against the same evidence; most hold none of it, which the map tells without moving them
    shared = pages.sparkSession.sparkContext.broadcast(_bitmap(repeated))

    @F.pandas_udf("array<struct<start: int, piece: bigint>>")
    def pieces(hosts: pd.Series, texts: pd.Series) -> pd.Series:
        keys = [_keys(host, text.split()) for host, text in zip(hosts, texts)]
        own = [(k, _in_map(k, shared.value)) for k in keys]
        return pd.Series([[{"start": a, "piece": p} for a, p in zip(at.tolist(), k[at].tolist())] for k, at in own], dtype=object)

    @F.pandas_udf("boolean")
    def matches(hosts: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([len(_in_map(_keys(h, t.split()), shared.value)) > 0 for h, t in zip(hosts, texts)], dtype=bool)

    @F.pandas_udf("binary")
    def packed(hosts: pd.Series, texts: pd.Series) -> pd.Series:  # null without a match; texts move compressed
        own = [len(_in_map(_keys(h, t.split()), shared.value)) > 0 for h, t in zip(hosts, texts)]
        return pd.Series([zlib.compress(t.encode(), 1) if found else None for t, found in zip(texts, own)], dtype=object)

    @F.pandas_udf("string")
    def unpacked(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.decompress(t).decode() for t in texts], dtype=object)

    covered = written(  # narrow; broadcast by size alone, which saves moving the texts
        decided.select("host", "text_digest", F.inline(pieces("host", "text"))).distinct()
        .join(repeated, ["host", "piece"])
        .groupBy("host", "text_digest").agg(F.collect_list("start").alias("at"))  # one entry per word at most
        .select("host", "text_digest", F.pandas_udf(_covered_words, "bigint")("at").alias("n")),
        "covered",
    )
    zero = F.lit(0).cast("bigint")
    plain = decided.where(~matches("host", "text")).select("page_id", "url", "text", zero.alias("n_repeated"))
    own = packed.asNondeterministic()("host", "text")  # not asked again by the filter
    held = (
        decided.select("page_id", "url", "host", "text_digest", own.alias("packed")).where("packed IS NOT NULL")
        .join(covered, ["host", "text_digest"], "left")
        .select("page_id", "url", unpacked("packed").alias("text"), F.coalesce("n", zero).alias("n_repeated"))
    )
    return plain.unionByName(held).unionByName(found.withColumn("n_repeated", zero))
