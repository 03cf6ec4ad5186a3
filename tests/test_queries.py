"""Every registered query against its oracle, and the shape of plans that must scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from vacanta.plans import catalog

from .compare import differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES  # the training-data operators have tests of their own
ORACLES = catalog.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    n, problems = differences(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert not problems and n > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "find_existing", "split_passed_rejected", "cosine_relevance", "scrape_predicates",
    "lookup_external_id", "skill_match", "text_search", "hybrid_rrf", "extract_keywords",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_or_cross_joins(spark, name):
    plan = plan_of(spark, name)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(spark, "scrape_predicates")
    # both rules sit directly on the scan, below every join
    on_scan = r"Filter [^\n]*o_totalprice#\d+ >= 4000.0[^\n]*o_orderdate#\d+ >= 1999[^\n]*\n[^\n]*FileScan"
    assert re.search(on_scan, plan)
    assert "GreaterThanOrEqual(o_totalprice,4000.0)" in plan


def test_row_functions_do_not_shuffle(spark):
    from vacanta.operators import prose

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    for df in (prose.redact_pii(docs, "text"), prose.reflow_paragraphs(docs, "text")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("text_search", "vector_search"):
        assert "WindowGroupLimit" in plan_of(spark, name)
