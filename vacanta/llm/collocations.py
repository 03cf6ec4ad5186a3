"""Phrase collocations per language, mined by Toivonen's sampling method with exact counts.

A sample of the documents proposes the frequent words and word pairs. A full pass then counts the proposals
and their negative border, that is every phrase that was not proposed although all its shorter parts
were: all words, all pairs of proposed words, and all triples of proposed pairs. Where a phrase of the
border turns out frequent, phrases that contain it may be frequent without having been counted; further
passes count just those, until no pass brings a new frequent word or pair. A phrase has three words at
most, so there are at most three such passes, and the result never depends on the sample, only the work does.

The border is large, so these passes count hashed codes of phrases: a shuffled row is two numbers. Codes that two
phrases share make a count too large, never too small. The last pass counts the phrases themselves, word for word, where their code was
frequent, and only these counts are results.

Words are looked up once: texts are written as ``chunks``, numbers of words with the words they stand for, and all
passes read those.

What is proposed or frequent by code travels as a bitmap of ``BITS`` bits per phrase length, put together by Spark
and of the same size for every corpus. Phrases that share a bit with another one are counted as well, which
adds work and changes no result. Tasks count in vocabularies and sorted arrays of bounded size and give
out sums per phrase, so a frequent phrase costs one row per full buffer before the shuffle.

Defined cases: null texts are empty; a null language is ``und``; rows that repeat count each time; texts are
read in parts of about ``PART`` bytes that end where a piece ends; an empty table gives no phrases. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

LEAST = 10  # occurrences of a candidate
LONGEST = 3  # words of a candidate
TOP = 2000
UNKNOWN = "und"
#: One document in ``SAMPLE`` proposes; what it proposes occurs at least ``PROPOSED`` times there.
SAMPLE = 8
PROPOSED = 2
#: Bits of a proposal map.
BITS = 1 << 26
#: Words a task gathers before it gives out sums; different words it remembers, of all languages.
BUFFER = 1 << 20
VOCABULARY = 1 << 18
PART = 1 << 20
#: Bits of a code that travel; phrases that share them are counted together until the last pass.
CODE_BITS = 46
_MAP_BITS = 32768  # bits of one bitmap that Spark builds
_ROWS = 1 << 17
CHUNK = "lang string, ids binary, codes binary, words binary"
# A chunk may have megabytes, so the writer looks at its sizes after every row, not after a hundred.
_CHUNK_OPTIONS = {
    "parquet.block.size": str(1 << 24),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

# What ends a piece, and what stands between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")


def _parts(text: str) -> Iterator[bytes]:
    """The text, lower-cased in ASCII, with ``\\n`` for the end of a piece, in parts that end there."""
    plain = text.encode("utf-8", "replace").lower().translate(_TABLE)
    start = 0
    while len(plain) - start > PART:
        end = plain.find(b"\n", start + PART)
        if end < 0:
            break
        yield plain[start:end]
        start = end
    yield plain[start:]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _has(bits: np.ndarray | None, codes: np.ndarray) -> np.ndarray:
    """Which codes have their bit in a map; no map has all."""
    if bits is None:
        return np.ones(len(codes), dtype=bool)
    at = (codes >> np.uint64(2)) & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


@dataclass(frozen=True)
class Maps:
    """Bitmaps of words, pairs and triples; ``None`` stands for all of them."""

    words: np.ndarray | None = None
    pairs: np.ndarray | None = None
    triples: np.ndarray | None = None


class _Buffer:
    """Words of one language, gathered by a task; 0 ends a piece."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.ids: dict[bytes, int] = {b"\n": 0}
        self.codes: list[int] = [0]
        self.gathered: list[np.ndarray] = []
        self.size = 0

    def add(self, part: bytes) -> None:
        tokens = list(filter(None, part.replace(b"\n", b" \n ").split(b" ")))
        ids, codes = self.ids, self.codes
        prefix = self.lang.encode() + b"\0"
        for token in set(tokens).difference(ids):
            ids[token] = len(codes)
            codes.append(xxhash.xxh64_intdigest(prefix + token))
        self.gathered.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
        self.gathered.append(np.zeros(1, dtype=np.int64))
        self.size += len(tokens)

    def taken(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """What was gathered, as ids, codes of the ids, and words; the buffer starts again."""
        out = np.concatenate(self.gathered), np.array(self.codes, dtype=np.uint64), list(self.ids)
        self.gathered, self.size = [], 0
        return out


def _sized(codes: np.ndarray, size: int) -> np.ndarray:
    return (codes & np.uint64((1 << CODE_BITS) - 4)) | np.uint64(size)


def _codes(ids: np.ndarray, codes: np.ndarray, longest: int, now: Maps, done: Maps | None) -> Iterator[np.ndarray]:
    """Codes of the phrases that ``now`` proposes with their border and ``done`` does not, one array per length."""
    own = codes[ids]
    real = ids > 0
    if done is None:  # words are all counted in the first pass
        yield _sized(own[real], 1)
    if longest > 1:
        proposed = (_has(now.words, codes) & (np.arange(len(codes)) > 0))[ids]
        both = proposed[:-1] & proposed[1:]
        if done is not None:
            before = _has(done.words, codes)[ids]
            both &= ~(before[:-1] & before[1:])
        at = np.flatnonzero(both)
        yield _sized(_mixed(own[at], own[at + 1]), 2)
    if longest > 2:
        pairs = _mixed(own[:-1], own[1:])
        proposed = real[:-1] & real[1:] & _has(now.pairs, pairs)
        both = proposed[:-1] & proposed[1:]
        if done is not None:
            before = _has(done.pairs, pairs)
            both &= ~(before[:-1] & before[1:])
        at = np.flatnonzero(both)
        yield _sized(_mixed(pairs[at], own[at + 2]), 3)


def _names(ids: np.ndarray, codes: np.ndarray, words: list[bytes], heavy: Maps) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """``(length, columns of word ids, n)`` of the phrases that have their bits in ``heavy``."""
    n_words = len(words)
    n = np.bincount(ids, minlength=n_words)
    n[0] = 0
    seen = np.flatnonzero((n > 0) & _has(heavy.words, codes))
    yield 1, [seen], n[seen]
    own = codes[ids]
    pairs = _mixed(own[:-1], own[1:])
    is_heavy = (ids[:-1] > 0) & (ids[1:] > 0) & _has(heavy.pairs, pairs)
    at = np.flatnonzero(is_heavy)
    found, n = np.unique(ids[at] * n_words + ids[at + 1], return_counts=True)
    yield 2, [found // n_words, found % n_words], n
    at = np.flatnonzero(is_heavy[:-1] & is_heavy[1:])
    at = at[_has(heavy.triples, _mixed(pairs[at], own[at + 2]))]
    found, n = np.unique((ids[at] * n_words + ids[at + 1]) * n_words + ids[at + 2], return_counts=True)
    yield 3, [found // (n_words * n_words), found // n_words % n_words, found % n_words], n


def _buffers(frames: Iterator[pd.DataFrame]) -> Iterator[_Buffer]:
    """Buffers as they are full, and what is left of them in the end."""
    buffers: dict[str, _Buffer] = {}
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            for part in _parts(text):
                if lang not in buffers:
                    buffers[lang] = _Buffer(lang)
                buffers[lang].add(part)
                known = sum(len(x.codes) for x in buffers.values())
                if known > VOCABULARY or sum(x.size for x in buffers.values()) >= BUFFER:
                    yield from [x for x in buffers.values() if x.gathered]
                    if known > VOCABULARY:
                        buffers.clear()
    yield from [x for x in buffers.values() if x.gathered]


def chunks(docs: DataFrame) -> DataFrame:
    """``CHUNK`` rows of ``(text, lang)``: words as numbers from 1 on, 0 ends a piece; their codes, from number 0 on,
    and the words, from number 1 on, joined by spaces."""

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for full in _buffers(frames):
            ids, codes, words = full.taken()
            used = np.bincount(ids, minlength=len(words)) > 0
            used[0] = True
            ids = (np.cumsum(used) - 1).astype(np.int32)[ids]
            at = np.flatnonzero(used)
            yield pd.DataFrame(
                {
                    "lang": [full.lang], "ids": [ids.tobytes()], "codes": [codes[at].tobytes()],
                    "words": [b" ".join([words[i] for i in at[1:].tolist()])],
                }
            )

    return docs.mapInPandas(numbered, CHUNK)


def _numbers(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and codes of a chunk."""
    ids, codes = (batch.column(c)[row].as_buffer() for c in ("ids", "codes"))
    return np.frombuffer(ids, np.int32).astype(np.int64), np.frombuffer(codes, np.uint64)


def code_counts(chunked: DataFrame, longest: int, now: Maps, done: Maps | None = None) -> DataFrame:
    """``(code, n)``: occurrences per hashed phrase; the two lowest bits of a code are the number of words.

    Phrases of equal codes are counted together, so a count is never too small.
    """
    shared = chunked.sparkSession.sparkContext.broadcast((now, done))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for found in _codes(*_numbers(batch, row), longest, *shared.value):
                    found, n = np.unique(found, return_counts=True)
                    for k in range(0, len(n), _ROWS):
                        part = slice(k, k + _ROWS)
                        yield pa.RecordBatch.from_arrays([found[part].view(np.int64), n[part]], ["code", "n"])

    counted = chunked.select("ids", "codes").mapInArrow(count, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def phrase_counts(chunked: DataFrame, heavy: Maps) -> DataFrame:
    """``(lang, size, phrase, n)`` of the phrases that have their bits in ``heavy``, counted exactly.

    Size 0 is the number of all words of a language.
    """
    shared = chunked.sparkSession.sparkContext.broadcast(heavy)

    def rows_of(keys: list[bytes], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lang = batch.column("lang")[at].as_py()
                head = f"{len(lang)}:{lang}".encode("utf-8", "replace")
                ids, codes = _numbers(batch, at)
                words = [b"\n", *filter(None, batch.column("words")[at].as_py().split(b" "))]
                yield rows_of([head], np.array([np.count_nonzero(ids)]))
                for _, columns, n in _names(ids, codes, words, shared.value):
                    for k in range(0, len(n), _ROWS):
                        part = slice(k, k + _ROWS)
                        rows = zip(*[c[part].tolist() for c in columns])
                        yield rows_of([head + b" ".join([words[i] for i in row]) for row in rows], n[part])

    # language and phrase travel as one text: the length of the language's name, the name, the phrase
    counted = chunked.mapInArrow(count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    length = F.substring_index("key", ":", 1)
    start = F.length(length) + 2
    parsed = counted.select(
        F.substring("key", start, length.cast("int")).alias("lang"),
        F.substring("key", start + length.cast("int"), F.length("key")).alias("phrase"), "n",
    )
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return parsed.select("lang", size.alias("size"), "phrase", "n")


def _bits(counts: DataFrame, sizes: Sequence[int]) -> list[np.ndarray]:
    """The bitmaps of the codes of each size; at most ``BITS`` bits a size reach the driver."""
    at = F.shiftrightunsigned("code", 2).bitwiseAND(F.lit(BITS - 1))
    rows = (
        counts.groupBy(F.col("code").bitwiseAND(F.lit(3)).alias("size"), F.floor(at / _MAP_BITS).alias("map"))
        .agg(F.bitmap_construct_agg(at % _MAP_BITS).alias("bits"))
        .toPandas()
    )
    out = {size: np.zeros(BITS // 8, dtype=np.uint8) for size in sizes}
    for size, number, bits in zip(rows["size"], rows["map"], rows["bits"]):
        start = int(number) * (_MAP_BITS // 8)
        out[int(size)][start : start + _MAP_BITS // 8] = np.frombuffer(bits, dtype=np.uint8)
    return [out[size] for size in sizes]


def frequent(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """``(lang, size, phrase, n)`` of all phrases with at least ``least`` occurrences, counted exactly.

    Size 0 holds the number of words of every language.
    """
    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang")
    )
    drawn = written(chunks(rows.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)), "drawn", _CHUNK_OPTIONS)
    some = F.col("n") >= proposed
    (words,) = _bits(code_counts(drawn, 1, Maps()).where(some), [1])
    no_words = Maps(np.zeros_like(words))  # words are counted, pairs are not
    (pairs,) = _bits(code_counts(drawn, 2, Maps(words), no_words).where(some), [2])

    chunked = written(chunks(rows), "chunks", _CHUNK_OPTIONS)
    now, done = Maps(words, pairs), None
    heavy = [np.zeros_like(words) for _ in range(3)]
    while True:
        counts = code_counts(chunked, LONGEST, now, done).where(F.col("n") >= least)
        heavy = [old | new for old, new in zip(heavy, _bits(counts, [1, 2, 3]))]
        # what is frequent and was not proposed opens phrases that no pass has counted
        wider = Maps(now.words | heavy[0], now.pairs | heavy[1])
        if (wider.words == now.words).all() and (wider.pairs == now.pairs).all():
            break
        now, done = wider, now
    return phrase_counts(chunked, Maps(*heavy)).where((F.col("n") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of every language.

    ``how`` goes to ``frequent``. Scores are quotients of decimals of 38 digits and exact.
    """
    counts = written(frequent(docs, least, text, lang, **how), "frequent")
    totals = counts.where("size = 0").select("lang", "n")
    known = counts.where("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = candidates.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).withColumns(
        {
            "first": F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " "),
            "rest": F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("size")), " "),
        }
    )
    for part, name in (("first", "l"), ("rest", "r")):
        values = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = cuts.join(values, ["lang", part])
    exact = "cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))"
    scored = cuts.withColumn("score", F.expr(f"({exact}) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
    worst = (
        scored.groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
        .select("lang", "phrase", "cut.*")
    )
    # phrases that mostly occur inside a longer candidate
    words = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(words, k + 1, LONGEST - 1), " ") for k in range(2)])
    longer = (
        candidates.where(F.col("size") == LONGEST)
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    left = (
        worst.join(longer, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    )
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i
        FROM worded, (SELECT unnest(range(1, {LONGEST + 1})) AS s) WHERE len(w) >= s)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {LEAST}
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(w[k:k + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS k FROM candidates WHERE size = 3)
  ) GROUP BY lang, phrase
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM worst w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
  WHERE g.a IS NULL OR 100 * g.a < 50 * w.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
