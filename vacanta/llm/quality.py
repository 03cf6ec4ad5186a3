"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL.

Features are words and punctuation runs with their pairs, hashed into a fixed number of
buckets; a word followed by itself is a feature of its own. A value is ``1 + log(count)``,
scaled so that the vector has length 1. The fit reads a bounded number of labelled rows
(``max_rows``, chosen by a hash of the id) in a fixed number of shards: each shard runs one
follow-the-regularised-leader learner and the weights of the shards are averaged. Everything
else covers all rows.

Defined cases: null and empty texts have no feature and get the score of the bias alone;
labels that are null or contradict each other for one id are left out of the fit; without any
label every score is 0.5. All other columns are kept; columns with the names of the result are
replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_pieces

BITS = 18
BUCKETS = 1 << BITS
#: Labelled rows the fit reads at most, and the learners that share them.
MAX_ROWS = 20_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.002, 0.001
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHED = 1 << 20
_SAME = np.uint32(0x5BD1E995)


class _Hashes(dict):
    """crc32 of words seen before."""

    def __missing__(self, word: str) -> int:
        self[word] = code = zlib.crc32(word.encode("utf-8", "replace"))
        return code


_hashes = _Hashes()


def _piece_buckets(piece: str) -> np.ndarray:
    words = _TOKEN.findall(piece)
    codes = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint32, count=len(words))
    left, right = codes[:-1], codes[1:]
    pairs = np.where(left == right, _SAME, left * np.uint32(0x01000193) + right)
    return (np.concatenate([codes, pairs]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and their values. Pairs do not cross the pieces of a very long text."""
    if len(_hashes) > _CACHED:
        _hashes.clear()
    pieces = list(word_pieces(text)) if text else []
    if len(pieces) <= 1:
        found = _piece_buckets(pieces[0]) if pieces else np.zeros(0, dtype=np.uint32)
        buckets, counts = np.unique(found, return_counts=True)
    else:
        dense = np.zeros(BUCKETS, dtype=np.int64)
        for piece in pieces:
            dense += np.bincount(_piece_buckets(piece), minlength=BUCKETS)
        buckets = np.flatnonzero(dense)
        counts = dense[buckets]
    values = 1.0 + np.log(counts)
    return buckets, values / max(np.sqrt((values**2).sum()), 1e-12)


class FtrlLearner:
    """FTRL-proximal logistic regression; the last coordinate is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros(BUCKETS + 1)
        self.n = np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: float) -> None:
        at = np.append(buckets, BUCKETS)
        x = np.append(values, 1.0)
        w = self.weights(at)
        g = (_sigmoid(w @ x) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0))))


def _fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
    learner = FtrlLearner()
    rows = rows.sort_values("place")
    for _ in range(EPOCHS):
        for text, label in zip(rows["text"], rows["label"]):
            learner.learn(*features(None if pd.isna(text) else text), float(label))
    weights = learner.weights()
    used = np.flatnonzero(weights)
    return pd.DataFrame({"bucket": used.astype(np.int32), "weight": weights[used]})


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", max_rows: int = MAX_ROWS,
) -> np.ndarray:
    """Weights per bucket and the bias, from at most ``max_rows`` labelled documents."""
    place = F.xxhash64(F.col("id"))
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("id", "label", place.alias("place"))
        .orderBy("place", "id")
        .limit(max_rows)  # documented bound of the fit
    )
    rows = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most max_rows narrow rows
        .withColumn("shard", F.pmod("place", F.lit(SHARDS)))
    )
    fitted = (
        rows.groupBy("shard")
        .applyInPandas(_fit_shard, "bucket int, weight double")
        .groupBy("bucket")
        .agg((F.sum("weight") / SHARDS).alias("weight"))
        .toPandas()  # at most one row per bucket
    )
    weights = np.zeros(BUCKETS + 1)
    weights[fitted["bucket"].to_numpy()] = fitted["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``quality_score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        for texts in batches:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                buckets, values = features(None if pd.isna(t) else t)
                out[k] = _sigmoid(weights[buckets] @ values + weights[BUCKETS])
            yield pd.Series(out)

    return docs.withColumn("quality_score", scored(F.col(text)))
