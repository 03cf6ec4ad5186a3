"""Relevance and retrieval against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.operators import relevance, search

ESSAYS = "id bigint, question string, answer string, keywords array<string>, embedding array<float>"
QUERIES = "query_id bigint, text string, embedding array<float>"


@pytest.fixture
def essays(spark):
    return spark.createDataFrame(
        [
            (1, "What is Python programming?", "Python is a versatile programming language.",
             ["python", "programming", "language"], [1.0, 0.0]),
            (2, "What is machine learning?", "Machine learning is a subset of AI.",
             ["machine learning", "AI", "data science"], [0.0, 1.0]),
            (3, "What is data engineering?", "Data engineering involves building data pipelines.",
             ["data", "engineering", "pipelines"], None),
        ],
        ESSAYS,
    )


def ask(spark, *texts):
    return spark.createDataFrame([(i, t, [1.0, 0.2]) for i, t in enumerate(texts)], QUERIES)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.text_rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_text_search(spark, essays):
    asked = ask(spark, "python programming", "pipelines", "xyznonexistent", "data", "machine learning AI")
    got = found(search.text_search(essays, asked, 10))
    assert got == {0: [1], 1: [3], 3: [3, 2], 4: [2]}
    assert found(search.text_search(essays, asked, 1))[3] == [3]


def test_text_search_all_terms_and_stored_index(spark, essays):
    asked = ask(spark, "python pipelines", "data engineering")
    assert found(search.text_search(essays, asked, 10)) == {0: [1, 3], 1: [3, 2]}
    assert found(search.text_search(essays, asked, 10, match_all=True)) == {1: [3]}
    index = search.text_index(essays)
    for match_all in (False, True):
        stored = search.search_postings(index, asked, 10, match_all=match_all)
        live = search.text_search(essays, asked, 10, match_all=match_all)
        assert sorted(stored.collect()) == sorted(live.collect())


def test_index_weights(spark, essays):
    row = search.text_index(essays).where("id = 3 AND term = 'data'").first()
    assert (row.n_a, row.n_b) == (2, 2)


def test_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(500, 8)).astype(np.float32)
    asked = rng.normal(size=(40, 8)).astype(np.float32)
    corpus[10] = corpus[20]  # a tie, broken by id
    asked[0] = corpus[10]
    rows = [(i, v.tolist()) for i, v in enumerate(corpus)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(7)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, embedding array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(corpus).T, 9)
    want = {
        q: sorted(range(500), key=lambda i: (-scores[q, i], i))[:5] for q in range(40)
    }
    for block in (2048, 7):  # all queries in one pass, and split into blocks
        got = {}
        for r in search.vector_search(df, queries, 5, block=block).orderBy("vector_rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert want[0][:2] == [10, 20]


def test_vector_search_puts_rows_without_direction_last(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, None)], "id bigint, embedding array<float>")
    got = search.vector_search(df, ask(spark, "x"), 5).orderBy("vector_rank").collect()
    assert [(r.id, r.similarity is None) for r in got] == [(2, False), (1, True)]


def test_vectors_of_other_width_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id bigint, embedding array<float>")
    with pytest.raises(Exception, match="width|matmul|mismatch"):
        search.vector_search(df, ask(spark, "x"), 5).collect()


def test_rrf_by_hand(spark):
    hits = "query_id bigint, id bigint, {} bigint"
    v = spark.createDataFrame([(0, 10, 1), (0, 11, 2)], hits.format("vector_rank"))
    t = spark.createDataFrame([(0, 10, 1), (0, 12, 2)], hits.format("text_rank"))
    got = {r.id: r for r in search.hybrid_rrf(v, t).collect()}
    assert got[10].score == pytest.approx(1 / 61, abs=1e-12)
    assert got[11].score == pytest.approx(0.5 / 62, abs=1e-12) and got[11].text_rank is None
    assert [got[i].rank for i in (10, 11, 12)] == [1, 2, 3]  # equal scores: smaller id first
    assert search.hybrid_rrf(v, t, limit=1).count() == 1
    only_text = search.hybrid_rrf(v, t, vector_weight=0.0).orderBy("rank").collect()
    assert [r.id for r in only_text] == [10, 12, 11]


def test_hybrid_search(spark, essays):
    got = search.hybrid_search(essays, ask(spark, "data pipelines", "   "), 10).collect()
    assert {r.query_id for r in got} == {0}
    third = next(r for r in got if r.id == 3)
    assert third.vector_rank is None and third.text_rank == 1
    assert search.hybrid_search(essays, ask(spark, "data"), 0).count() == 0


def test_search_essays(spark, essays):
    from vacanta.operators.embed import backfill_embeddings
    from vacanta.plans.essay_search import search_essays

    stamped = essays.withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("created_at", "updated_at")})
    corpus = backfill_embeddings(stamped, 32, only_missing=False)
    asked = spark.createDataFrame([(0, "  data pipelines "), (1, " \t")], "query_id bigint, text string")
    got = search_essays(corpus, asked, dim=32, limit=2).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got][0] == (0, 3) and len(got) == 2
    assert got[0].preview.startswith("**Question:** What is data engineering?\n**Answer:** ")


def test_mmr(spark):
    pool = spark.createDataFrame(
        [(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.9, [1.0, 0.0]), (0, 3, 0.5, [0.0, 1.0]), (0, 4, 0.4, None)],
        "query_id bigint, id bigint, score double, embedding array<float>",
    )
    order = lambda d, n=10: [r.id for r in search.mmr_diversify(pool, d, n).orderBy("mmr_rank").collect()]
    assert order(1.0) == [1, 2, 3, 4]
    assert order(0.5) == [1, 3, 4, 2]
    assert order(0.5, 2) == [1, 3]


def unit(c):
    return [1.0, 0.0, 0.0], [c, math.sqrt(1 - c * c), 0.0]


def test_relevance(spark):
    cv = [1.0, 0.0, 0.0]
    cases = {
        1: ("d", unit(0.5)[1], True), 2: ("d", unit(0.3)[1], False), 3: (None, unit(0.3)[1], True),
        4: ("", unit(0.3)[1], True), 5: ("d", None, True), 6: ("d", [0.0, 0.0, 0.0], False),
        7: ("d", [float("nan"), 1.0, 0.0], False), 8: ("d", [0.4, 0.0, math.sqrt(0.84)], True),
    }
    jobs = spark.createDataFrame(
        [(i, 1, d, v) for i, (d, v, _) in cases.items()] + [(20, 2, "d", cv), (21, 3, "d", [0.0, 1.0, 0.0]), (22, 9, "d", cv)],
        "arrival bigint, user_id bigint, description string, embedding array<double>",
    )
    cvs = spark.createDataFrame([(1, "cv", cv), (2, "", cv), (3, "cv", None)], "user_id bigint, text string, embedding array<double>")
    got = {r.arrival: r.is_relevant for r in relevance.cosine_relevance(jobs, cvs).collect()}
    assert got == {**{i: ok for i, (_, _, ok) in cases.items()}, 20: True, 21: True, 22: True}


def test_route_and_store(spark):
    scored = spark.createDataFrame(
        [(1, True, "1", "u1"), (2, False, "2", "u2"), (3, True, "1", "u3"), (4, True, "4", "u4")],
        "arrival bigint, is_relevant boolean, external_id string, source_url string",
    ).withColumn("source", F.lit("s"))
    store = spark.createDataFrame([("4", "x", "s")], "external_id string, source_url string, source string")
    skills = spark.createDataFrame(
        [(1, [["Python"]], []), (2, [["SQL"]], [])],
        "arrival bigint, must_have_skills array<array<string>>, nice_to_have_skills array<array<string>>",
    )
    got = {r.arrival: r for r in relevance.route_and_store(scored, store, skills).collect()}
    assert got[1].must_have_skills == [["Python"]] and got[3].must_have_skills == []
    assert got[2].must_have_skills is None and got[2].store_status == "in_progress"
    assert {a: r.outcome for a, r in got.items()} == {1: "stored", 2: "stored", 3: "duplicate", 4: "duplicate"}
    assert got[3].store_status == "error" and {r.status for r in got.values()} == {"completed"}
