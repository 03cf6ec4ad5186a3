"""The pipeline stage by stage against plain versions, and the registered queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import differences
from vacanta.llm import queries as llm

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    n, problems = differences(spark, SF, name, llm.QUERIES[name], llm.ORACLES.get(name))
    assert not problems and n > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        seen.append(docs)
    read, language, quality, lines, single, packed = seen
    assert all(s.columns == COLUMNS for s in seen[:-1])
    assert language.count() == read.count()  # all texts are in a language
    ids = {r.doc_id for r in quality.collect()}
    judged = [(labels[i], i in ids) for i in labels]
    assert sum(kept for q, kept in judged if q == 1) >= 0.97 * sum(q == 1 for q, _ in judged)
    before = {r.doc_id: r for r in quality.collect()}
    for r in lines.collect():
        assert r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text))
    from vacanta.llm import simhash

    found = {r.component_id for r in simhash.near_duplicates(lines).collect()}
    assert {r.doc_id for r in single.collect()} == found
    path = corpus_pipeline.tokenizer_path()
    from tests.llm.test_text_operators import check_packing

    check_packing([(r.doc_id, r.text) for r in single.collect()], packed.toPandas(), path)


def test_awkward_documents_pass_all_stages(spark):
    rows = [(1, None), (2, ""), (3, "the same words\nin two lines"), (3, "the same words\nin two lines"), (None, "no id"), (4, "12 %")]
    docs = spark.createDataFrame(
        [(i, t, None, None, None, "x") for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string",
    )
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.written(stage(spark, frame, SF), name)
            frame.count()
