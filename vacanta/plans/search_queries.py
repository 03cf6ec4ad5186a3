"""Queries on retrieval: the essay corpus searched by the benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from . import bindings as b
from . import sql_text as sql
from .bindings import with_views
from .registry import query

LIMIT = 10
POOL = LIMIT * search.OVERFETCH


def _terms_sql(relation: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, {sql.singular("tok")} AS term FROM (
  SELECT {keys}, unnest({sql.tokens(text)}) AS tok FROM {relation}) WHERE tok NOT IN {sql.STOPS}"""


TEXT_SQL = f"""occurrences AS (
  SELECT id, term, CAST(1 AS DOUBLE) AS weight FROM ({_terms_sql("qa_pairs", "id", "question")})
  UNION ALL SELECT id, term, CAST(0.4 AS DOUBLE)
    FROM ({_terms_sql("qa_pairs", "id", "answer")})),
asked AS (SELECT DISTINCT query_id, term FROM ({_terms_sql("queries", "query_id", "text")})),
text_scores AS (SELECT query_id, id,
    round(CAST(count(*) FILTER (weight = 1) AS DOUBLE)
      + count(*) FILTER (weight < 1) * CAST(0.4 AS DOUBLE), 9) AS text_score
  FROM occurrences JOIN asked USING (term) GROUP BY query_id, id),
text_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY text_score DESC, id) AS text_rank FROM text_scores) WHERE text_rank <= {POOL})"""

VECTOR_SQL = f"""vector_scores AS (SELECT q.query_id, p.id,
    round({sql.cosine("p.embedding", "q.embedding")}, 9) AS similarity
  FROM qa_pairs p, queries q WHERE p.embedding IS NOT NULL),
vector_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY similarity DESC, id) AS vector_rank FROM vector_scores) WHERE vector_rank <= {POOL})"""

FUSED_SQL = f"""fused AS (SELECT coalesce(v.query_id, t.query_id) AS query_id,
    coalesce(v.id, t.id) AS id, vector_rank, text_rank,
    round(coalesce(CAST(0.5 AS DOUBLE) / (60 + vector_rank), 0)
      + coalesce(CAST(0.5 AS DOUBLE) / (60 + text_rank), 0), 12) AS score
  FROM vector_hits v FULL OUTER JOIN text_hits t ON t.query_id = v.query_id AND t.id = v.id),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= {LIMIT})"""


@query(
    "text_index",
    with_views("qa_pairs", "queries")
    + f""",\n{TEXT_SQL}
SELECT id, term, count(*) FILTER (weight = 1) AS n_a, count(*) FILTER (weight < 1) AS n_b
FROM occurrences GROUP BY id, term""",
)
def text_index(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_index(b.qa_pairs(spark, sf))


@query(
    "text_search",
    with_views("qa_pairs", "queries")
    + f""",\n{TEXT_SQL}
SELECT query_id, id, text_score, text_rank FROM text_hits""",
)
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(b.qa_pairs(spark, sf), b.queries(spark, sf), POOL)


@query(
    "text_search_all_terms",
    with_views("queries")
    + f""",
occurrences AS ({_terms_sql("documents", "doc_id", "text")}),
asked AS (SELECT DISTINCT query_id, term FROM ({_terms_sql("queries", "query_id", "text")})),
scores AS (SELECT query_id, doc_id, round(count(*) * CAST(0.4 AS DOUBLE), 9) AS text_score
  FROM occurrences JOIN asked USING (term) GROUP BY query_id, doc_id
  HAVING count(DISTINCT term) = (SELECT count(*) FROM asked a WHERE a.query_id = asked.query_id))
SELECT query_id, doc_id, text_score, text_rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY text_score DESC, doc_id) AS text_rank FROM scores)
WHERE text_rank <= {LIMIT}""",
)
def text_search_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold every term of a passage."""
    docs = b.documents(spark, sf).select(
        "doc_id",
        F.lit(None).cast("string").alias("question"),
        F.col("text").alias("answer"),
        F.lit(None).cast("array<string>").alias("keywords"),
    )
    return search.text_search(
        docs, b.queries(spark, sf), LIMIT, key="doc_id", match_all=True
    )


@query(
    "vector_search",
    with_views("queries")
    + f""",
scores AS (SELECT q.query_id, e.vec_id, round({sql.cosine("e.embedding", "q.embedding")}, 9)
    AS similarity FROM embeddings e, queries q)
SELECT query_id, vec_id, similarity, vector_rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS vector_rank FROM scores)
WHERE vector_rank <= {LIMIT}""",
)
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    corpus = b.table(spark, sf, "embeddings")
    return search.vector_search(corpus, b.queries(spark, sf), LIMIT, key="vec_id")


@query(
    "hybrid_rrf",
    with_views("qa_pairs", "queries")
    + f""",\n{TEXT_SQL},\n{VECTOR_SQL},\n{FUSED_SQL}
SELECT query_id, id, score, vector_rank, text_rank, rank FROM final""",
)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(b.qa_pairs(spark, sf, vectors=True), b.queries(spark, sf), LIMIT)


@query("mmr_diversify")
def mmr_diversify(spark: SparkSession, sf: str) -> DataFrame:
    """The vector candidates of every query, re-ranked for variety."""
    corpus = b.table(spark, sf, "embeddings")
    hits = search.vector_search(corpus, b.queries(spark, sf), POOL, key="vec_id")
    # hits are few (queries x pool); their vectors come back by id after the top-k
    pool = hits.join(corpus.select("vec_id", "embedding"), "vec_id")
    return search.mmr_diversify(pool, 0.5, LIMIT, key="vec_id", relevance="similarity")
