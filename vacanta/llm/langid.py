"""Language identification: multinomial naive Bayes over hashed character n-grams.

The training counts of every labelled document are added up in the map tasks, one array per
language, and summed by Spark; the model is one row of log probabilities per language, whose
size depends on the number of languages and buckets only. It is broadcast, and a document is
scored with one sparse product of its n-gram counts.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if
nothing was learned. Texts of any length are read in pieces. Repeated rows are scored alike and
count as often as they occur. Ties go to the language that sorts first. All other columns are
kept; columns with the names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, written

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Bound on the mean log probability of an n-gram, see ``in_known_language``.
QUANTILE = 0.01
MARGIN = 1.0
MARGIN_SHORT = 3.0


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of the documents, per language
    log_prob: np.ndarray  # buckets x languages


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the character n-grams of the lower-cased text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    overlap = max(ORDERS) - 1
    for start in range(0, max(len(text), 1), PIECE):
        before = overlap if start else 0
        piece = text[start - before : start + PIECE]
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        for n in ORDERS:
            skip = max(0, before - n + 1)  # n-grams that the piece before has counted
            size = len(codes) - n + 1 - skip
            if size <= 0:
                continue
            mixed = np.full(size, n * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                mixed = (mixed ^ codes[skip + k : skip + k + size]) * np.uint32(0x01000193)
                mixed ^= mixed >> np.uint32(15)
            buckets = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(18)
            counts += np.bincount(buckets, minlength=BUCKETS)
    return counts


def _count_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
            counts[lang] += ngram_counts(text)
            documents[lang] = documents.get(lang, 0) + 1
    for lang, array in counts.items():
        seen = np.flatnonzero(array)
        yield pd.DataFrame(
            {
                "lang": lang,
                "bucket": np.append(seen, -1).astype(np.int32),  # -1: number of documents
                "n": np.append(array[seen], documents[lang]),
            }
        )


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from every row with a text and a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counted = (
        rows.mapInPandas(_count_batches, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most languages x (buckets + 1) rows
    )
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    documents = np.ones(len(languages))
    for k, name in enumerate(languages):
        own = counted[counted["lang"] == name]
        buckets, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[buckets[buckets >= 0], k] = n[buckets >= 0]
        documents[k] = n[buckets == -1].sum()
    smooth = counts + 0.5
    return LanguageModel(
        list(languages),
        np.log(documents / documents.sum()) if languages else documents,
        np.log(smooth / smooth.sum(axis=0)),
    )


def predict_fit(model: LanguageModel, text: str | None) -> tuple[str, float, float, int]:
    """Language, posterior probability, mean log probability of an n-gram in that language, number of n-grams."""
    if text is None or not model.languages or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, 0
    counts = ngram_counts(text)
    seen = np.flatnonzero(counts)
    likelihood = counts[seen] @ model.log_prob[seen]
    evidence = model.prior + likelihood
    best, total = int(np.argmax(evidence)), int(counts.sum())
    score = float(1.0 / np.exp(evidence - evidence[best]).sum())
    return model.languages[best], score, float(likelihood[best] / total), total


def predict(model: LanguageModel, text: str | None) -> tuple[str, float]:
    return predict_fit(model, text)[:2]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` (posterior probability of the prediction)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = [predict(model, None if pd.isna(t) else t) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "lang_score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    return docs.withColumn("_language", score(F.col(text))).select(*kept, "_language.*")


def in_known_language(docs: DataFrame, model: LanguageModel, is_training: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows in a learned language.

    The posterior only tells the learned languages apart. Whether a text is in one of them is told by its mean log
    probability per n-gram: for every language the bound is the ``QUANTILE`` of that mean over all its training
    documents that are recognised, less ``MARGIN`` and ``MARGIN_SHORT`` / sqrt(n-grams) for the chance of short texts.
    A language none of whose training documents is recognised has no bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, score double, fit double, n int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [predict_fit(shared.value, None if pd.isna(t) else t) for t in texts]
            yield pd.DataFrame(rows, columns=["pred", "score", "fit", "n"])

    found = written(docs.select("*", score(F.col(text)).alias("_language")), "language")
    steps = (
        found.where(is_training & (F.col(lang) == F.col("_language.pred")))
        .groupBy(F.col("_language.pred").alias("lang"), F.floor(F.col("_language.fit") * 100).alias("step"))
        .agg(F.count("*").alias("n"))
        .toPandas()  # hundredths of a nat: a few thousand rows a language at most
    )
    least = F.lit(float("-inf"))
    for name, own in steps.sort_values("step").groupby("lang"):
        at = int(np.searchsorted(own["n"].cumsum().to_numpy(), QUANTILE * own["n"].sum()))
        least = F.when(F.col("_language.pred") == name, float(own["step"].iloc[at]) / 100 - MARGIN).otherwise(least)
    return found.where(
        (F.col("_language.pred") != UNDETERMINED)
        & (F.col("_language.score") >= 0.5)
        & (F.col("_language.fit") >= least - MARGIN_SHORT / F.sqrt("_language.n"))
    ).select(*docs.columns)
