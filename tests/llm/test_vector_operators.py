"""Vector operators on awkward rows and against brute force; components on long chains."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vacanta.llm import covertree, rangejoin
from vacanta.llm.components import components

SCHEMA = "vec_id bigint, embedding array<double>, label int, n_links string, rank string"


def awkward():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 4))
    rows = [(k, [float(x) for x in v], int(k % 2)) for k, v in enumerate(base)]
    near = base[:20] + rng.normal(size=(20, 4)) * 0.05
    rows += [(100 + k, [float(x) for x in v], int(k % 2)) for k, v in enumerate(near)]
    rows += [(200 + k, rows[0][1], 0) for k in range(9)]
    rows += [
        (300, None, 0), (301, [], 0), (302, [0.0] * 4, 0), (303, [1.0, None, 0.0, 0.0], 0), (304, [math.nan] * 4, 0),
        (305, [math.inf, 0.0, 0.0, 0.0], 0), (306, rows[0][1], None), (350, [1.0, 2.0], 0), (351, [1.0, 2.0], 0), (200, rows[0][1], 0),
    ]
    return [(*row, "old", "old") for row in rows]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def check_range_join(spark, monkeypatch=None):
    rows = awkward()
    got = rangejoin.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    links = [set() for _ in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
                if any(a[1]) and any(b[1]) and cosine(a[1], b[1]) >= 0.98:
                    links[i].add(j)
    want = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        want.append((row[0], len(links[i]), least, row[0] == least))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(want)


def test_range_join(spark):
    check_range_join(spark)
    assert rangejoin.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_range_join_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "CELL", 8)
    monkeypatch.setattr(rangejoin, "BLOCK", 5)
    check_range_join(spark)


def brute_top(rows, k):
    whole = {}
    for row in rows:
        if usable(row[1]):
            whole.setdefault(row[0], [math.floor(256 * x) for x in row[1]])
    out = []
    for q in whole:
        if q % 50 == 0:
            scored = [(-int(np.dot(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def check_top(spark):
    rows = awkward()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = covertree.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 5)


def test_top_k(spark):
    check_top(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert covertree.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_many_nodes(spark, monkeypatch):
    for name, value in (("SHARD", 12), ("GROUP", 2), ("LEAF", 4), ("FANOUT", 6)):
        monkeypatch.setattr(covertree, name, value)
    check_top(spark)


def test_large_components_are_exact(spark):
    huge = [2.0**20, 1.0, 3.0]
    rows = [(0, huge), (1, [2.0**19, 5.0, 7.0]), (2, [1e300, 0.0, 0.0])]
    got = covertree.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)
    best = {r.vec_id: r.score for r in got.collect()}
    assert best[1] == 2**28 * 2**27 + 256 * 1280 + 768 * 1792 and best[2] == 2**56


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5, 5), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 1 for k in range(1, 301)) and all(got[1000 + k] == 1000 for k in range(400))
    assert len(got) == 700
