"""Packing of tokenised documents into fixed windows by non-negative least squares.

A document's ids fill whole windows as far as they go; the rest (shorter than a window) falls into a
length class of ``GRAIN`` ids. Combinations of up to ``DEPTH`` classes that fill a window exactly are
enumerated; non-negative least squares finds how often each has to repeat so that the histogram of
the rests is used up; the counts are rounded down, then raised greedily as far as the histogram allows.
Only the histogram (one number per class) reaches the driver. Rests that no combination takes are laid end
to end and cut at every window; the end of that line is cut into powers of two, which need no padding.
So the padding is what rounding up to classes leaves, less than ``GRAIN`` x ``DEPTH`` ids per window.

Positions in the line and ranks in a class come from running totals inside the parts of the
written token table plus one offset per part; no class and no line is gathered in one task.

Defined cases: null and empty texts are the end id alone; every row is packed, repeated rows and repeated ids
each on their own; an empty table gives no pieces. Texts of any length are read in pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import word_pieces, written

WINDOW = 2048
GRAIN = 8
DEPTH = 3
END_ID = 1
_CACHED = 1 << 20
_LONGEST = 48  # longer words are encoded each time
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = re.compile(r"[^\S \n]")
_PLAIN = re.compile(r"(\n?)([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?%$#&*|]*)")


def _byte_letters() -> dict[int, str]:
    """The letters byte-level tokenizers write for bytes: printable bytes stand for themselves, the
    others follow in order from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class _Words(dict):
    """Ids of words as they follow a space; a word that a line break starts follows nothing.

    Letters are one word for the pre-tokenizer and go to the model itself; marks after them are
    words of their own. What is met after ``_CACHED`` words is encoded each time.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.marks: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def letters(self, word: str, space: str = "") -> bytes:
        if not word.isascii():  # ASCII letters stand for themselves
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        found = [t.id for t in self.model.tokenize(space + word)]
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: str) -> bytes:
        found = _PLAIN.fullmatch(word)
        if found:
            line, head, tail = found.groups()
            if tail not in self.marks:
                if len(self.marks) > _CACHED:
                    self.marks = {"": b""}
                self.marks[tail] = self.ids(tail)
            if line:
                ids = self.ids(line) + self.letters(head) + self.marks[tail]
            else:
                ids = (self[head] if tail else self.letters(head, _BYTE_LETTERS[32])) + self.marks[tail]
        else:
            ids = self.ids(word if word[:1] == "\n" else " " + word)
        if len(self) < _CACHED and len(word) <= _LONGEST:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a text as little-endian 32-bit numbers, word by word.

    A byte-level pre-tokenizer always starts a new word at a single space or line break between two
    other characters, and where letters end. So what stands between such places can be encoded alone
    and remembered.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)

    def encode_part(self, piece: str) -> bytes:
        odd = "  " in piece or "\n\n" in piece or " \n" in piece or "\n " in piece
        if odd or piece[0] == " " or piece[-1] in " \n" or _RARE_SPACE.search(piece):
            first, *words = _SPACE.split(piece)
        else:
            first, *words = piece.replace("\n", " \n").split(" ")
        return self.words.ids(first) + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> np.ndarray:
        parts = [self.encode_part(p) for p in word_pieces(text)] if text else []
        parts.append(np.array([END_ID], dtype="<u4").tobytes())
        return np.frombuffer(b"".join(parts), dtype="<u4")


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_encoders: dict[str, WordEncoder] = {}


def tokenised(docs: DataFrame, tokenizer: str, doc_id: str, text: str) -> DataFrame:
    """``(row, doc_id, n, crcs, rest_crc, rest)``: checksums of the whole windows, and the ids after them."""

    @F.pandas_udf("n bigint, crcs array<bigint>, rest_crc bigint, rest binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        width = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for texts in batches:
            rows = []
            for t in texts:
                ids = encoder.encode(None if pd.isna(t) else t)
                whole = len(ids) // WINDOW * WINDOW
                crcs = [checksum(ids[k : k + WINDOW]) for k in range(0, whole, WINDOW)]
                rest = ids[whole:]
                rows.append((len(ids), crcs, checksum(rest), rest.astype(width).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "crcs", "rest_crc", "rest"])

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), encode(text).alias("t")
    ).select("row", "doc_id", "t.*")


def combinations(size: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending class lists of up to ``depth`` members that add up to ``size``."""
    found = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not head or left >= head[-1]:
            found.append((*head, left))
        if len(head) + 1 < depth:
            for k in range(head[-1] if head else 1, left // 2 + 1):
                extend((*head, k), left - k)

    extend((), size)
    return found


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ``|a x - b|``, by active sets over normal equations."""
    x = np.zeros(a.shape[1])
    active = np.zeros(0, dtype=np.int64)
    refused: list[int] = []
    scale = max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a[:, active] @ x[active])
        gradient[active] = gradient[refused] = -np.inf
        enters = int(np.argmax(gradient))
        if gradient[enters] <= 1e-6 * scale:
            break
        active = np.append(active, enters)
        while len(active):
            own = a[:, active]
            solved = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(active)), own.T @ b)
            falling = solved <= 0
            if not falling.any():
                x[active] = solved
                break
            now = x[active]
            step = np.min(now[falling] / (now[falling] - solved[falling] + 1e-300))
            x[active] = np.maximum(now + step * (solved - now), 0.0)
            stays = x[active] > 1e-9 * scale
            x[active[~stays]] = 0.0
            active = active[stays]
        if x[enters] == 0.0:  # it fell out at once: another column has to enter
            refused.append(enters)
        else:
            refused.clear()
    return x


def plan(histogram: dict[int, int], size: int = WINDOW // GRAIN) -> list[tuple[tuple[int, ...], int]]:
    """``(combination, repeats)`` that never use more rests of a class than there are."""
    left = np.zeros(size + 1, dtype=np.int64)
    for k, n in histogram.items():
        left[k] = n
    combos = combinations(size)
    used = [c for c in combos if all(left[k] for k in c)]
    if not used:
        return []
    matrix = np.zeros((size + 1, len(used)))
    for column, combo in enumerate(used):
        for k in combo:
            matrix[k, column] += 1
    wanted = least_squares(matrix, left.astype(float))
    chosen: dict[tuple[int, ...], int] = {}

    def take(combo: tuple[int, ...], most: int) -> None:
        repeats = min([most, *(int(left[k]) // combo.count(k) for k in set(combo))])
        if repeats > 0:
            chosen[combo] = chosen.get(combo, 0) + repeats
            for k in combo:
                left[k] -= repeats

    by_count = np.argsort(-wanted, kind="stable")
    for column in by_count:
        take(used[column], int(wanted[column]))
    for column in by_count:  # then whatever still fits
        take(used[column], int(left.max()))
    return sorted(chosen.items())


def _slots(chosen, first_sequence: int):
    """Per class: where its runs of ranks start, with sequence, members per sequence and place."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = first_sequence
    for combo, repeats in chosen:
        for k in sorted(set(combo)):
            start, m = taken.get(k, 0), combo.count(k)
            runs.setdefault(k, []).append((start, sequence, m, combo.index(k)))
            taken[k] = start + repeats * m
        sequence += repeats
    columns = {k: np.array(v, dtype=np.int64).T for k, v in runs.items()}
    return columns, taken, sequence


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that come earlier by (part, row)."""
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum(value).alias("total"))  # one row per written part
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return (
        rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "part")
        .withColumn(name, F.col(name) + F.col("offset"))
        .drop("offset")
    )


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    tokens = written(tokenised(docs, tokenizer, doc_id, text), "tokens")
    whole = F.expr(f"n div {WINDOW}")
    narrow = tokens.select(
        "row", F.shiftright("row", _ROW_BITS).alias("part"), "doc_id", "n", "crcs", "rest_crc",
        whole.alias("whole"), (F.col("n") % WINDOW).alias("length"),
    )
    sized = narrow.withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int"))
    inside = Window.partitionBy("part", "class").orderBy("row")
    ranked = cut(
        _before(sized, "whole", "whole_before").withColumn("rank", F.row_number().over(inside) - 1)
    )

    # whole windows are sequences of their own
    windows = ranked.where("whole > 0").select(
        "doc_id", "n", "whole_before", F.posexplode("crcs").alias("k", "crc")
    ).select(
        "doc_id", (F.col("k") * WINDOW).cast("bigint").alias("start"), F.lit(WINDOW).alias("length"),
        "crc", "n", (F.col("whole_before") + F.col("k")).alias("sequence_id"), F.lit(0).alias("offset"),
    )
    n_windows = ranked.agg(F.sum("whole")).first()[0] or 0

    rests = ranked.where("length > 0")
    counts = rests.groupBy("class", "part").agg(F.count("*").alias("m"))
    histogram = {r["class"]: r["m"] for r in counts.groupBy("class").agg(F.sum("m").alias("m")).collect()}
    runs, taken, next_sequence = _slots(plan(histogram), int(n_windows))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "class", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("class_before")
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.assign(sequence_id=-1, place=0)
            rank = frame["rank"].to_numpy()
            sequence, order = np.full(len(frame), -1), np.zeros(len(frame), dtype=np.int64)
            for k, at in frame.groupby("class").indices.items():
                at = at[rank[at] < taken.get(k, 0)]
                if not len(at):
                    continue
                first, base, members, lane = runs[k]
                run = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[run]
                sequence[at] = base[run] + inside // members[run]
                order[at] = lane[run] + inside % members[run]
            out["sequence_id"], out["place"] = sequence, order
            yield out[["row", "part", "doc_id", "n", "whole", "length", "rest_crc", "sequence_id", "place"]]

    # ids go through pandas as text: a null among numbers would turn them into floats
    doc_type = ranked.schema["doc_id"].dataType
    id_text = F.col("doc_id").cast("string").alias("doc_id")
    placed = cut(
        rests.join(starts, ["class", "part"])
        .select(
            "row", "part", id_text, "n", "whole", "length", "rest_crc", "class",
            (F.col("rank") + F.col("class_before")).alias("rank"),
        )
        .mapInPandas(
            place,
            "row bigint, part bigint, doc_id string, n bigint, whole bigint, length bigint, "
            "rest_crc bigint, sequence_id bigint, place bigint",
        )
    )
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    combined = placed.where("sequence_id >= 0").select(  # at most DEPTH rows in a sequence
        "doc_id", (F.col("whole") * WINDOW).alias("start"), "length", F.col("rest_crc").alias("crc"), "n",
        "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
    )

    # the others end to end, cut at every window and, at the end, at powers of two
    line = _before(placed.where("sequence_id < 0"), "length", "at")
    total = placed.where("sequence_id < 0").agg(F.sum("length")).first()[0] or 0
    tail = int(total) // WINDOW * WINDOW
    borders = [tail]
    for bit in reversed(range(WINDOW.bit_length())):
        if (int(total) - tail) >> bit & 1:
            borders.append(borders[-1] + (1 << bit))

    def cut_line(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                ids = np.frombuffer(row.rest, dtype=f"<u{len(row.rest) // row.length}")
                at, end = row.at, row.at + row.length
                while at < end:
                    if at < tail:
                        begin, stop = at // WINDOW * WINDOW, at // WINDOW * WINDOW + WINDOW
                        sequence = begin // WINDOW
                    else:
                        k = int(np.searchsorted(borders, at, side="right")) - 1
                        begin, stop = borders[k], borders[k + 1]
                        sequence = tail // WINDOW + k
                    stop = min(stop, end)
                    own = ids[at - row.at : stop - row.at]
                    out.append(
                        (row.doc_id, row.whole * WINDOW + at - row.at, stop - at, checksum(own), row.n,
                         next_sequence + sequence, at - begin)
                    )
                    at = stop
            yield pd.DataFrame(
                out, columns=["doc_id", "start", "length", "crc", "n", "sequence_id", "offset"]
            )

    cuts = (
        line.select("row", "doc_id", "n", "whole", "length", "at")
        .join(tokens.select("row", "rest"), "row")
        .mapInPandas(
            cut_line,
            "doc_id string, start bigint, length bigint, crc bigint, n bigint, "
            "sequence_id bigint, offset bigint",
        )
    )
    return (
        windows.withColumn("doc_id", id_text).unionByName(combined).unionByName(cuts)
        .select(
            F.col("doc_id").cast(doc_type).alias("doc_id"), "start", F.col("length").cast("bigint").alias("length"),
            F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id",
            F.col("offset").cast("bigint").alias("offset"),
        )
    )
