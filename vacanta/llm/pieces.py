"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reports every piece that ends at a position, by following output links; a single
Viterbi pass relaxes the best score there. Two rules of relaxation, by the kind of the model:

* unigram: the best sum of scores wins, ties to the longer last piece, then the smaller id;
* BPE: a piece may follow the last piece of its start only if merging the two pieces' characters in order
  of score gives back these two pieces. Exactly one piece per reachable position
  passes, and the path is what merging the whole text gives.

Characters that no piece covers become byte pieces, if the model has them, else the unknown id. A text is cut before every
word mark that follows another character (no piece may cross such a place, which is checked when the model is
read), and words seen before are remembered.

Defined cases: null and empty texts have no ids and decode to empty text; a word mark in a text counts as a
space; special pieces in a text are ordinary characters; texts of any length are read in pieces. Other columns are kept; columns with the names of
the result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_pieces

MARK = "▁"  # stands for a space
_CACHED = 1 << 18  # words and pairs remembered, each
_LONGEST = 48
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNIGRAM, BPE = "unigram", "bpe"


class PieceModel:
    """The pieces of a model file, as the file's own library lists them."""

    def __init__(self, path: str, kind: str = BPE) -> None:
        from sentencepiece import SentencePieceProcessor

        listed = SentencePieceProcessor(model_file=path)
        ids = range(listed.get_piece_size())
        special = [listed.is_control(k) or listed.is_unknown(k) or listed.is_byte(k) for k in ids]
        self.setup(
            {listed.id_to_piece(k): (k, listed.get_score(k)) for k in ids if not special[k]},
            {int(listed.id_to_piece(k)[3:5], 16): k for k in ids if listed.is_byte(k)},
            listed.unk_id(), kind,
        )

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], unknown: int = 0, kind: str = UNIGRAM) -> PieceModel:
        model = cls.__new__(cls)
        model.setup(pieces, {}, unknown, kind)
        return model

    def setup(self, pieces, byte_ids, unknown: int, kind: str) -> None:
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"unknown kind of model: {kind}")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses the start of a word")
        self.pieces, self.byte_ids, self.unknown, self.kind = pieces, byte_ids, unknown, kind
        self.automaton = ahocorasick.Automaton()
        for piece, (number, score) in pieces.items():
            self.automaton.add_word(piece, (len(piece), number, score, piece))
        if pieces:
            self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        size = max([unknown, *byte_ids.values(), *(k for k, _ in pieces.values())]) + 1
        self.surface: list[bytes] = [b""] * size
        for piece, (number, _) in pieces.items():
            self.surface[number] = piece.replace(MARK, " ").encode()
        for value, number in byte_ids.items():
            self.surface[number] = bytes([value])
        self.surface[unknown] = " ⁇ ".encode()

    def uncovered(self, char: str) -> list[int]:
        if self.byte_ids:
            return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]
        return [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, highest score first and leftmost among equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.pieces.get(parts[k] + parts[k + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjacent(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart when their characters are merged."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > _CACHED:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def viterbi(self, text: str) -> list[int]:
        """Ids of ``text`` in one pass over the reports of the automaton."""
        size = len(text)
        last: list = [None] * (size + 1)  # (length, ids, score so far, piece) of the best last piece
        last[0] = (0, (), 0.0, "")
        reports = self.automaton.iter(text) if self.pieces else iter(())
        waiting = next(reports, None)
        bpe = self.kind == BPE
        for end in range(1, size + 1):
            best = None
            while waiting is not None and waiting[0] == end - 1:
                length, number, score, piece = waiting[1]
                before = last[end - length]
                if bpe:
                    if best is None and (not before[0] or self.adjacent(before[3], piece)):
                        best = (length, (number,), 0.0, piece)
                else:
                    total = before[2] + score
                    if best is None or (total, length, -number) > (best[2], best[0], -best[1][0]):
                        best = (length, (number,), total, piece)
                waiting = next(reports, None)
            if best is None:
                char = text[end - 1]
                # the lowest score of all: only where no piece covers the character
                best = (1, tuple(self.uncovered(char)), last[end - 1][2] - 1e6, char)
            last[end] = best
        parts, end = [], size
        while end:
            parts.append(last[end][1])
            end -= last[end][0]
        return [k for ids in reversed(parts) for k in ids]

    def _words(self, marked: str) -> bytes:
        words = _WORD.findall(marked)
        known = self.known
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = np.array(self.viterbi(word), dtype="<u4").tobytes()
                if len(word) <= _LONGEST and len(known) < _CACHED:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text, spaces kept, with one space in front of it."""
        if not text:
            return np.zeros(0, dtype="<u4")
        marked = [self._words(p.replace(" ", MARK)) for p in word_pieces(" " + text, ends=" ")]
        return np.frombuffer(b"".join(marked), dtype="<u4")

    def decode(self, ids) -> str:
        text = b"".join([self.surface[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[tuple[str, str], PieceModel] = {}


def _model(path: str, kind: str) -> PieceModel:
    if (path, kind) not in _models:
        _models[path, kind] = PieceModel(path, kind)
    return _models[path, kind]


def encode(docs: DataFrame, path: str, kind: str = BPE, text: str = "text") -> DataFrame:
    """Add ``piece_ids`` (array of int). ``path`` is the model file, on every executor."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(path, kind)
        for texts in batches:
            yield pd.Series([model.encode(None if pd.isna(t) else t).astype(np.int32) for t in texts], dtype=object)

    return docs.withColumn("piece_ids", encoded(F.col(text)))


def checked(docs: DataFrame, path: str, kind: str = BPE, text: str = "text") -> DataFrame:
    """Add ``n_pieces``, ``ids_crc32`` (of the ids as little-endian 32-bit numbers) and ``round_trip``.

    Encodes and decodes in one pass, so that the ids of all texts need not travel.
    """

    @F.pandas_udf("n_pieces bigint, ids_crc32 bigint, round_trip boolean")
    def passed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(path, kind)
        for texts in batches:
            rows = []
            for t in texts:
                given = "" if pd.isna(t) else t
                ids = model.encode(given)
                back = model.decode(ids.tolist()) == given.replace(MARK, " ")
                rows.append((len(ids), zlib.crc32(ids.tobytes()), back))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "round_trip"])

    names = ("n_pieces", "ids_crc32", "round_trip")
    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("_checked", passed(F.col(text))).select(*kept, "_checked.*")


def decode(rows: DataFrame, path: str, kind: str = BPE, ids: str = "piece_ids") -> DataFrame:
    """Add ``decoded_text``."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(path, kind)
        for column in batches:
            yield pd.Series(["" if k is None else model.decode(k.tolist()) for k in column], dtype=object)

    return rows.withColumn("decoded_text", decoded(F.col(ids)))
