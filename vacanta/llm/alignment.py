"""Alignment of the tokens of two tokenizers by skipping along diagonals.

Both tokenizers cover the same bytes, so their tokens are two ascending arrays of end offsets. Where they cut alike,
the arrays hold the same numbers at a constant shift of the index: exponential probing compares stretches of doubling
length at the current shift and halves back to the first difference, so a one-to-one stretch is
jumped in a logarithm of its length. What follows is an irregular group, walked token by token to the
next common end, which sets the new shift. A group's links are the pairs of tokens whose bytes overlap.

How many documents hold a pair of ids linked is counted over the whole corpus: a document gives every
pair once, with how often it links it. Pairs are counted in the map tasks first. The counts go back to the
documents in two ways: the most frequent pairs, ``HOT`` at most, as a broadcast table, so that no frequent pair is
ever a key of a shuffle; all others by a join on the pair.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens, zeros and
an empty digest. Rows that repeat are documents of their own. Long texts are aligned in parts that end where both tokenizers
start a token. An empty table gives no rows. Only the id and the text are read; other columns are not kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import word_pieces
from .packing import WordEncoder, _byte_letters
from .pieces import MARK

#: Pairs in the broadcast table, at most.
HOT = 1 << 19
#: One-to-one tokens that are compared one by one before stretches double.
SHORT = 4
_CACHED = 1 << 18  # words remembered
_ODD = re.compile(r"[^\S \n]|  |\n\n| \n|\n ")


def alignment(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Groups of two ascending lists of ends as ``(first a, first b, a tokens, b tokens)``.

    A stretch of one-to-one groups comes as one entry with the same number on both sides, and more than
    one; so does a group of one token each. An irregular group has different numbers, or equal numbers
    that share only their last end, given as negative numbers.
    """
    i = j = 0
    size_a, size_b = len(a), len(b)
    while i < size_a and j < size_b:
        left = min(size_a - i, size_b - j)
        run, short = 0, min(left, SHORT)
        while run < short and a[i + run] == b[j + run]:
            run += 1
        if run == SHORT:
            width = SHORT
            while run < left and a[i + run : i + run + width] == b[j + run : j + run + width]:
                run += width
                width *= 2
            while width > 1 and run < left:
                width //= 2
                if a[i + run : i + run + width] == b[j + run : j + run + width]:
                    run += width
            run = min(run, left)
        if run:
            yield i, j, run, run
            i, j = i + run, j + run
            if run == left:
                continue
        at, to = i, j
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        yield at, to, at - i, to - j


class _WordPieces(dict):
    """Ids of words that follow a space, as little-endian 32-bit numbers; ``None`` where the pieces change a word's bytes.

    What is met after ``_CACHED`` words is encoded each time.
    """

    def __init__(self, pieces, surface: list[bytes]) -> None:
        super().__init__()
        self.pieces, self.surface = pieces, surface

    def __missing__(self, word: str) -> bytes | None:
        ids = self.pieces.encode(word)
        same = b"".join(map(self.surface.__getitem__, ids)) == (" " + word).encode("utf-8", "replace")
        found = np.array(ids, dtype="<u4").tobytes() if same else None
        if len(self) < _CACHED:
            self[word] = found
        return found


class Aligner:
    """Two tokenizers and the alignment of texts."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.encoder = WordEncoder(bytes_path)
        self.encoder.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.pieces = SentencePieceProcessor(model_file=pieces_path)
        plain = {v: k for k, v in _byte_letters().items()}
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.surface_a = [b""] * (max(vocabulary.values()) + 1)
        for letters, number in vocabulary.items():
            self.surface_a[number] = b"".join(
                bytes([plain[c]]) if c in plain else c.encode("latin-1", "replace") for c in letters
            )
        self.size_b = self.pieces.get_piece_size()
        self.surface_b = [self._surface(k) for k in range(self.size_b)]
        # where no piece goes on after a space, the pieces of a word do not depend on its neighbours
        apart = not any(MARK in self.pieces.id_to_piece(k).lstrip(MARK) for k in range(self.size_b))
        self.words_b = _WordPieces(self.pieces, self.surface_b) if apart else None
        self.lengths_a = np.array([len(s) for s in self.surface_a])
        self.lengths_b = np.array([len(s) for s in self.surface_b])
        self.names_a = [str(k) for k in range(len(self.surface_a))]
        self.names_b = [str(k) for k in range(self.size_b)]

    def _surface(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(number) else piece.replace(MARK, " ").encode()

    def _parts(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both sides, part by part, and whether the second side's bytes are known to be the text's.

        The space between two parts belongs to the one after it.
        """
        for part in word_pieces(" " + text, ends=" "):
            rest = part[1:]
            if rest and rest[0] not in " \n" and rest[-1] not in " \n" and not _ODD.search(rest):
                # words follow single spaces or line breaks, the first one the space in front
                words = rest.replace("\n", " \n").split(" ")
                a = b"".join(map(self.encoder.words.__getitem__, words))
                b = self._by_word(rest)
            else:
                a, b = self.encoder.encode_part(part), None
            if b is None:
                ids_b = np.array(self.pieces.encode(rest), dtype=np.int64)
            else:
                ids_b = np.frombuffer(b, "<u4").astype(np.int64)
            yield np.frombuffer(a, "<u4"), ids_b, b is not None

    def _by_word(self, rest: str) -> bytes | None:
        """The second side's ids of words after single spaces; ``None`` if the words can not be taken one by one."""
        if self.words_b is None:
            return None
        found = list(map(self.words_b.__getitem__, rest.split(" ")))
        return None if None in found else b"".join(found)

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of both sides, groups, links, digest, the linked pairs ``a * size_b + b`` and how often each is linked."""
        none = np.zeros(0, dtype=np.int64)
        empty = (0, 0, 0, 0, "", none, none.astype(np.int32))
        if not text:
            return empty
        parts = list(self._parts(text))
        given = (" " + text).encode("utf-8", "replace")
        # a byte-level tokenizer keeps every byte of what it is given; pieces may not
        if sum(int(self.lengths_a[a].sum()) for a, _, _ in parts) != len(given):
            return empty
        if not all(exact for _, _, exact in parts):
            ids = chain.from_iterable([b.tolist() for _, b, _ in parts])
            if b"".join(map(self.surface_b.__getitem__, ids)) != given:
                return empty
        n_a = n_b = n_groups = 0
        digest, linked = hashlib.sha256(), []
        for number, (a, b, _) in enumerate(parts):
            groups, pairs = self._groups(a, b)
            n_a, n_b, n_groups = n_a + len(a), n_b + len(b), n_groups + len(groups)
            digest.update(((";" if number else "") + ";".join(groups)).encode())
            linked.append(pairs)
        pairs = np.concatenate(linked)
        codes, times = np.unique(pairs, return_counts=True)
        return n_a, n_b, n_groups, len(pairs), digest.hexdigest(), codes, times.astype(np.int32)

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[list[str], np.ndarray]:
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        left = list(map(self.names_a.__getitem__, ids_a.tolist()))
        right = list(map(self.names_b.__getitem__, ids_b.tolist()))
        groups: list[str] = []
        for i, j, n, m in alignment(ends_a.tolist(), ends_b.tolist()):
            if n == 1:
                groups.append(f"{left[i]}|{right[j]}")
            elif n > 0:
                groups += map("|".join, zip(left[i : i + n], right[j : j + n]))
            else:
                groups.append(f"{','.join(left[i : i - n])}|{','.join(right[j : j - m])}")
        # from one end of either side to the next, bytes lie in one token of each
        ends = np.concatenate([ends_a, ends_b])
        ends.sort(kind="stable")  # two ascending runs: one merge
        ends = ends[np.append(ends[1:] != ends[:-1], True)]
        first, second = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        return groups, ids_a[first].astype(np.int64) * self.size_b + ids_b[second]


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times)`` of every row.

    ``codes`` are the linked pairs, each once, as the first id times the size of the second vocabulary plus the second id.
    """

    @F.pandas_udf(
        "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<bigint>, times array<int>"
    )
    def align(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = _aligner(bytes_path, pieces_path)
        for texts in batches:
            yield pd.DataFrame([both.align(None if pd.isna(t) else t) for t in texts], columns=_COLUMNS)

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), align(text).alias("t")
    ).select("row", "doc_id", "t.*")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``(code, n, best)``: documents per linked pair, and whether no pair of its first id has more."""
    counts = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    # a first id has at most as many pairs as the second vocabulary has ids
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("code") / size_b)))
    return counts.withColumn("best", F.col("n") == most)


def _hot_from(counts: DataFrame, hot: int) -> int:
    """The least class of counts from which on at most ``hot`` pairs follow; classes grow by a tenth."""
    classes = counts.groupBy("class").agg(F.count("*").alias("pairs")).orderBy(F.col("class").desc()).collect()
    total, least = 0, 1 << 30
    for r in classes:  # a few hundred rows: counts are below 1.1 ** class
        total += r["pairs"]
        if total > hot:
            break
        least = r["class"]
    return least


def align_tokens(docs: DataFrame, bytes_path: str, pieces_path: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row."""
    rows = written(aligned(docs, bytes_path, pieces_path, doc_id, text), "aligned")
    size_b = _aligner(bytes_path, pieces_path).size_b
    counts = written(
        pair_counts(rows, size_b).withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.1))).cast("int")), "pairs"
    )
    least = _hot_from(counts, hot)
    frequent = F.broadcast(counts.where(F.col("class") >= least).select("code", "n", "best"))
    others = counts.where(F.col("class") < least).select("code", "n", "best")
    links = rows.select("row", F.inline(F.arrays_zip("codes", "times"))).withColumnRenamed("codes", "code")

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("times")).alias("count_sum"),
        )

    rare = links.join(frequent.select("code"), "code", "left_anti").join(others, "code")
    sums = (
        summed(links.join(frequent, "code")).unionByName(summed(rare))
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    zero = F.lit(0).cast("bigint")
    return rows.drop("codes", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
