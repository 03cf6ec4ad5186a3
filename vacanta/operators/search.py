"""Retrieval: weighted term index, exact vector search, rank fusion, diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_stop_word, singular, tokens
from ..session import written
from .numbering import number_rows

# Field weights, fusion constant, candidate over-fetch.
WEIGHT_A = 1.0  # question and keywords
WEIGHT_B = 0.4  # answer
RRF_K = 60
OVERFETCH = 3

#: Queries scored in one pass over the corpus.
QUERY_BLOCK = 2048
_CELLS = 4_000_000  # similarities held at once by one task
_DIGITS = 9


def analysed_terms(df: DataFrame, keep: list[str | Column], text: Column) -> DataFrame:
    """One row per term occurrence of ``text``: no stop words, singular form."""
    return (
        df.select(*keep, F.explode(tokens(text)).alias("_token"))
        .where(~is_stop_word("_token"))
        .select(*[c if isinstance(c, str) else c for c in keep], singular("_token").alias("term"))
    )


def index_terms(essays: DataFrame, key: str = "id") -> DataFrame:
    """Term occurrences ``(key, term, is_a)`` of question, keywords (A) and answer (B)."""
    fields = F.array(
        F.struct(F.lit(True).alias("is_a"), F.col("question").alias("text")),
        F.struct(F.lit(True).alias("is_a"), F.array_join("keywords", " ").alias("text")),
        F.struct(F.lit(False).alias("is_a"), F.col("answer").alias("text")),
    )
    by_field = essays.select(key, F.explode(fields).alias("f")).select(key, "f.is_a", "f.text")
    return analysed_terms(by_field, [key, "is_a"], F.col("text"))


def text_index(essays: DataFrame, key: str = "id") -> DataFrame:
    """Postings ``(key, term, n_a, n_b)``: occurrences in the heavy and the light fields."""
    return (
        index_terms(essays, key)
        .groupBy(key, "term")
        .agg(F.count_if("is_a").alias("n_a"), F.count_if(~F.col("is_a")).alias("n_b"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    return analysed_terms(queries, ["query_id"], F.col("text")).distinct()


def search_postings(
    postings: DataFrame,
    queries: DataFrame,
    n: int,
    key: str = "id",
    match_all: bool = False,
) -> DataFrame:
    """``(query_id, key, text_score, text_rank)``: the best ``n`` matches of every query.

    The score is the weighted number of occurrences of the query's terms. A query without a
    match has no rows; ``match_all`` asks for every term. Query terms are broadcast when few,
    so only postings of asked terms leave the scan, already summed per document.
    """
    terms = query_terms(queries)
    if match_all:
        return _top(_holding_all(postings, terms, key), "text_score", "text_rank", n, key)
    matches = (
        postings.join(terms, "term")
        .groupBy("query_id", key)
        .agg(F.round(_text_score(), _DIGITS).alias("text_score"))
    )
    return _top(matches, "text_score", "text_rank", n, key)


def _text_score() -> Column:
    return F.sum("n_a") * F.lit(WEIGHT_A) + F.sum("n_b") * F.lit(WEIGHT_B)


def _holding_all(postings: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``(query_id, key, text_score)`` of the documents that hold every term of a query.

    The rarest term of a query names its candidates; the other terms are only looked up in those, so
    a common word costs nothing beyond its postings. A query with a term that no document holds has none.
    """
    asked = terms.select("term").distinct()
    held = written(
        postings.join(asked, "term")
        .groupBy(key, "term")
        .agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")),
        "held",
    )
    documents = held.groupBy("term").agg(F.count("*").alias("df"))
    wanted = (
        terms.join(documents, "term", "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("wanted"),
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rarest"),
        )
        .where("rarest.df > 0")
    )
    candidates = wanted.select("query_id", "wanted", F.col("rarest.term").alias("term")).join(
        held.select(key, "term"), "term"
    ).drop("term")
    found = candidates.join(terms, "query_id").join(held, [key, "term"])
    return (
        found.groupBy("query_id", key)
        .agg(
            F.round(_text_score(), _DIGITS).alias("text_score"),
            F.count("*").alias("seen"),
            F.first("wanted").alias("wanted"),
        )
        .where("seen = wanted")
        .select("query_id", key, "text_score")
    )


def text_search(
    essays: DataFrame, queries: DataFrame, n: int, key: str = "id", match_all: bool = False
) -> DataFrame:
    """Search without a stored index: term occurrences are matched as they are scanned."""
    occurrences = index_terms(essays, key).select(
        key,
        "term",
        F.col("is_a").cast("bigint").alias("n_a"),
        (~F.col("is_a")).cast("bigint").alias("n_b"),
    )
    return search_postings(occurrences, queries, n, key, match_all)


def _top(matches: DataFrame, score: str, rank: str, n: int, key: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), key)
    return (
        matches.withColumn(rank, F.row_number().over(best))
        .where(F.col(rank) <= n)
        .withColumn(rank, F.col(rank).cast("bigint"))
    )


def _unit_rows(values: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, lengths, out=np.full_like(values, np.nan), where=lengths > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError("embeddings differ in width")
    return flat.reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` best scores, ties by id."""
    if len(scores) > n:
        nth = np.partition(scores, len(scores) - n)[len(scores) - n]
        close = np.flatnonzero(scores >= nth)
    else:
        close = np.arange(len(scores))
    return close[np.lexsort((ids[close], -scores[close]))][:n]


def _scorer(query_ids: list, unit: np.ndarray, n: int, key: str, out: pa.Schema):
    """Arrow map function keeping the best ``n`` rows per query of one partition."""
    width = unit.shape[1]
    step = max(1, _CELLS // len(query_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_scores = [np.empty(0)] * len(query_ids)
        top_ids = [np.empty(0, dtype=np.int64)] * len(query_ids)
        bar = np.full(len(query_ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                found = np.round(unit @ _unit_rows(_matrix(part.column(1), width)).T, _DIGITS)
                # no direction, no similarity: such rows come last
                found = np.where(np.isnan(found), -np.inf, found)
                # only queries for which this part holds something good enough
                for q in np.flatnonzero(found.max(axis=1) >= bar):
                    scores = np.concatenate([top_scores[q], found[q]])
                    both = np.concatenate([top_ids[q], ids])
                    keep = _best(scores, both, n)
                    top_scores[q], top_ids[q] = scores[keep], both[keep]
                    if len(keep) == n:
                        bar[q] = scores[keep[-1]]
        for q, query_id in enumerate(query_ids):
            size = len(top_ids[q])
            if size:
                values = [None if s == -np.inf else float(s) for s in top_scores[q]]
                columns = [[query_id] * size, top_ids[q], values]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out
                )

    return run


def _score_block(corpus: DataFrame, block: list, n: int, key: str) -> DataFrame:
    query_ids = [row["query_id"] for row in block]
    values = np.array([row["embedding"] for row in block], dtype=np.float64)
    if values.ndim != 2:
        raise ValueError("query embeddings differ in width")
    out = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("similarity", pa.float64())])
    run = _scorer(query_ids, _unit_rows(values), n, key, out)
    return corpus.mapInArrow(run, f"query_id bigint, {key} bigint, similarity double")


def vector_search(
    corpus: DataFrame,
    queries: DataFrame,
    n: int,
    key: str = "id",
    vector: str = "embedding",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, key, similarity, vector_rank)``: exact top ``n`` by cosine distance.

    Rows without an embedding are left out. Every task scores its rows against a block of
    queries with one matrix product and emits at most ``n`` rows per query, so neither pairs
    nor vectors are shuffled. More queries than one block holds are numbered and cut into
    blocks, each block reading the corpus once more.
    """
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector)
    asked = queries.where("embedding IS NOT NULL").select(
        F.col("query_id").cast("bigint"), "embedding"
    )
    scored = None
    for part in _blocks(asked, block):
        found = _score_block(rows, part, n, key)
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        scored = corpus.sparkSession.createDataFrame(
            [], f"query_id bigint, {key} bigint, similarity double"
        )
    return _top(scored, "similarity", "vector_rank", n, key)


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    """Query rows in lists of at most ``block``, by their number: repeated and null ids separate."""
    rows = queries.limit(block + 1).collect()
    if len(rows) <= block:
        if rows:
            yield rows
        return
    numbered = number_rows(queries, ["query_id"])
    total = numbered.count()
    for start in range(0, total, block):
        yield numbered.where(F.col("n").between(start + 1, start + block)).drop("n").collect()


def hybrid_rrf(
    vector_hits: DataFrame,
    text_hits: DataFrame,
    vector_weight: float = 0.5,
    k: int = RRF_K,
    limit: int = 10,
    key: str = "id",
) -> DataFrame:
    """Fuse two ranked lists: ``w / (k + vector rank) + (1 - w) / (k + text rank)``.

    A list without the essay contributes nothing; ties go to the smaller id.
    """
    fused = vector_hits.select("query_id", key, "vector_rank").join(
        text_hits.select("query_id", key, "text_rank"), ["query_id", key], "full_outer"
    )

    def part(weight: float, rank: str) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(k) + F.col(rank)), F.lit(0.0))

    score = part(vector_weight, "vector_rank") + part(1 - vector_weight, "text_rank")
    ranked = _top(fused.withColumn("score", F.round(score, 12)), "score", "rank", limit, key)
    return ranked.select("query_id", key, "score", "vector_rank", "text_rank", "rank")


def hybrid_search(
    essays: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    vector_weight: float = 0.5,
    key: str = "id",
    match_all: bool = False,
) -> DataFrame:
    """Vector and text candidates (three times ``limit`` each), fused and cut to ``limit``.

    A blank query or a limit <= 0 finds nothing. Essays without an embedding take part by
    their text only.
    """
    asked = queries.where(~is_blank("text")) if limit > 0 else queries.limit(0)
    pool = max(limit, 0) * OVERFETCH
    return hybrid_rrf(
        vector_search(essays, asked, pool, key),
        text_search(essays, asked, pool, key, match_all),
        vector_weight,
        limit=limit,
        key=key,
    )


def mmr_diversify(
    candidates: DataFrame,
    diversity: float = 0.5,
    limit: int = 10,
    key: str = "id",
    relevance: str = "score",
) -> DataFrame:
    """Greedy re-ranking of each query's candidates ``(query_id, key, relevance, embedding)``.

    Picks the largest ``diversity * relevance - (1 - diversity) * nearest chosen``: 1 keeps
    the order by relevance, 0 spreads the results. The candidates of a query are a search
    result, at most three times its limit, so a group is small by construction.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([relevance, key], ascending=[False, True])
        gain = group[relevance].fillna(0.0).to_numpy()
        known = group["embedding"].notna().to_numpy()
        near = np.zeros((len(group), len(group)))
        if known.any():
            unit = np.nan_to_num(_unit_rows(np.array(list(group["embedding"][known]), dtype=float)))
            near[np.ix_(known, known)] = unit @ unit.T
        chosen: list[int] = []
        left = list(range(len(group)))
        values = []
        while left and len(chosen) < limit:
            worst = near[np.ix_(left, chosen)].max(axis=1) if chosen else np.zeros(len(left))
            value = np.round(diversity * gain[left] - (1 - diversity) * worst, _DIGITS)
            best = int(np.argmax(value))
            values.append(value[best])
            chosen.append(left.pop(best))
        picked = group.iloc[chosen][["query_id", key]].copy()
        picked["mmr_score"] = values
        picked["mmr_rank"] = np.arange(1, len(chosen) + 1)
        return picked

    return candidates.groupBy("query_id").applyInPandas(
        pick, f"query_id bigint, {key} bigint, mmr_score double, mmr_rank bigint"
    )
