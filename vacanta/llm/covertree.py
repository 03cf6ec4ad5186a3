"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are indexed together. A net of centres, chosen farthest first from a bounded sample,
forms the top level; every vector belongs to its nearest centre, and a node beyond ``SHARD`` data rows or ``GROUP``
queries is dealt into several of the same centre and radius. For a query node with centre q, radius s and a
data node with centre c, radius t no product exceeds ``q.c + s|c| + t|q| + st``.

Each query node first meets the data of its own centre, which gives every query a kth score. A pair of nodes is then
searched only if its bound reaches the worst kth score of the query node. Inside a task both sides become cover trees
(each child lies within half the scale of its parent), and pairs of their nodes are pruned by the
same bound. Where no net separates the points, a node is compared as one block.

Copies of a vector meet first: of equal vectors only the k + 1 smallest ids can be answers.
Vectors in high dimension without clusters have radii near their length: the bound then prunes little and
the work is that of comparing the query set with all rows, in blocks.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; rows without an id neither; vectors of
another length are no candidates; components are clipped to +-2^20 before scaling; rows that share an id are not
candidates of each other; ties go to the smaller id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .vectors import farthest_first, usable

SHARD = 8192
GROUP = 1024
SAMPLE = 8192
#: Centres at most; nodes of one centre are dealt into shards beyond that.
CENTRES = 1024
LEAF = 64
FANOUT = 32
SCALE, LIMIT = 256, 1 << 28
_LOWEST = int(np.iinfo(np.int64).min) + 1  # can be negated
_FOUND = "query_id bigint, vec_id bigint, score bigint"
_EXACT = 2.0**53


def quantised(vec: str) -> Column:
    """``floor(256 x)`` of every component as a whole number."""
    return F.transform(
        vec,
        lambda x: F.greatest(
            F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))
        ).cast("bigint"),
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


class Node:
    """A cover-tree node: the points ``at`` lie within ``radius`` of ``centre``."""

    def __init__(self, points: np.ndarray, at: np.ndarray) -> None:
        self.at = at
        own = points[at]
        self.centre = own[0]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))
        self.children: list[Node] = []
        if len(at) <= LEAF or self.radius == 0.0:
            return
        scale = 2.0 ** (np.ceil(np.log2(self.radius)) - 1)
        net = farthest_first(own, FANOUT + 1, scale)
        if len(net) > FANOUT:
            return
        nearest = np.argmin(((own[:, None] - own[net][None]) ** 2).sum(axis=2), axis=1)
        self.children = [Node(points, at[nearest == k]) for k in range(len(net)) if (nearest == k).any()]


def _bound(q: Node, d: Node) -> float:
    top = q.centre @ d.centre + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return float(top) + 1e-9 * (abs(top) + 1.0)


class DualTree:
    """Top k of every query of a task, ties to the smaller id."""

    def __init__(self, queries, query_ids, data, ids, floors, k: int) -> None:
        self.queries, self.query_ids, self.data, self.ids, self.k = queries, query_ids, data, ids, k
        self.scores = np.full((len(queries), k), _LOWEST)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.kth = floors.copy()  # nothing below the score a query already has can be an answer
        largest = float(np.abs(queries).max()) * float(np.abs(data).max()) * data.shape[1]
        self.number = np.float64 if largest < _EXACT else np.int64
        as_float = queries.astype(np.float64), data.astype(np.float64)
        self.left, self.right = as_float if self.number is np.float64 else (queries, data)
        self.roots = [Node(points, np.arange(len(points))) for points in as_float]

    def search(self) -> None:
        waiting = [tuple(self.roots)]
        while waiting:
            q, d = waiting.pop()
            if _bound(q, d) < self.kth[q.at].min():
                continue
            if not q.children and not d.children:
                self.compare(q.at, d.at)
                continue
            if d.children and (not q.children or d.radius >= q.radius):
                pairs = [(q, child) for child in d.children]
            else:
                pairs = [(child, d) for child in q.children]
            waiting += sorted(pairs, key=lambda p: _bound(*p))  # the most promising comes off first

    def compare(self, at: np.ndarray, others: np.ndarray) -> None:
        products = (self.left[at] @ self.right[others].T).astype(np.int64)
        products[self.query_ids[at][:, None] == self.ids[others][None]] = _LOWEST
        least = self.kth[at]
        if len(others) > self.k:
            least = np.maximum(least, np.partition(products, -self.k, axis=1)[:, -self.k])
        good = (products >= least[:, None]) & (products > _LOWEST)
        for row in np.flatnonzero(good.any(axis=1)):
            new, q = np.flatnonzero(good[row]), at[row]
            scores = np.append(self.scores[q], products[row, new])
            found = np.append(self.found[q], self.ids[others[new]])
            best = np.lexsort((found, -scores))[: self.k]
            self.scores[q], self.found[q] = scores[best], found[best]
            self.kth[q] = max(self.kth[q], self.scores[q, -1])


def _search(k: int):
    def search(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or data.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        query_ids = queries["vec_id"].to_numpy(dtype=np.int64)
        tree = DualTree(
            _matrix(queries["q"]), query_ids, _matrix(data["q"]), data["vec_id"].to_numpy(dtype=np.int64),
            queries["floor"].to_numpy(dtype=np.int64), k,
        )
        tree.search()
        row, column = np.nonzero(tree.scores > _LOWEST)
        return pd.DataFrame(
            {"query_id": query_ids[row], "vec_id": tree.found[row, column], "score": tree.scores[row, column]}
        )

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _place(rows: DataFrame, wanted: float) -> DataFrame:
    """Add the nearest centre as ``cell``; lengths that the sample does not hold are one cell."""
    drawn = (
        rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)  # the sample only places centres
        .select("dim", "q").toPandas()
    )
    centres = {}
    for dim, part in drawn.groupby("dim"):
        points = _matrix(part["q"]).astype(np.float64)
        most = int(np.ceil(min(wanted, CENTRES) * len(part) / len(drawn)))
        centres[int(dim)] = points[farthest_first(points, max(1, most))]
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, distance double, centre array<double>")
    def nearest(dims: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        cell, distance = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
        centre: list = [None] * len(dims)
        for dim, at in dims.groupby(dims).groups.items():
            at = np.array(at)
            points = _matrix(vectors.iloc[at]).astype(np.float64)
            own = shared.value.get(int(dim), np.zeros((1, int(dim))))
            apart = np.maximum(
                (points**2).sum(axis=1)[:, None] - 2 * points @ own.T + (own**2).sum(axis=1)[None], 0
            )
            cell[at] = np.argmin(apart, axis=1)
            exact = points - own[cell[at]]
            distance[at] = np.sqrt((exact**2).sum(axis=1))
            for k, c in zip(at, cell[at]):
                centre[k] = own[c]
        return pd.DataFrame({"cell": cell, "distance": distance, "centre": centre})

    return rows.withColumn("_n", nearest("dim", "q")).select("*", "_n.*").drop("_n")


def _nodes(rows: DataFrame, flag: str, size: int) -> DataFrame:
    """One row per node of one side: its centre, radius and the number of its parts."""
    return rows.where(flag).groupBy("dim", "cell").agg(
        F.ceil(F.count("*") / size).cast("int").alias("parts"),
        F.max("distance").alias("radius"), F.first("centre").alias("centre"),
    )


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vec_id, embedding`` that is a query."""
    rows = (
        vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
        .select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"),
            quantised("embedding").alias("q"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        )
        .distinct()
    )
    among_equals = Window.partitionBy("q").orderBy("vec_id")
    kept = (
        rows.select("vec_id", "q").distinct().withColumn("n", F.row_number().over(among_equals))
        .where(F.col("n") <= k + 1).select("vec_id", "q", F.lit(True).alias("is_data"))
    )
    # a vector that is only a query still has to be indexed
    rows = cut(rows.where("is_query").unionByName(kept, allowMissingColumns=True).select(
        "vec_id", "q", F.size("q").alias("dim"),
        F.coalesce("is_query", F.lit(False)).alias("is_query"), F.coalesce("is_data", F.lit(False)).alias("is_data"),
    ))
    placed = cut(_place(rows, rows.count() / SHARD))
    data_nodes = cut(_nodes(placed, "is_data", SHARD))
    query_nodes = cut(_nodes(placed, "is_query", GROUP))
    node = ["dim", "cell"]

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    data = placed.where("is_data").join(data_nodes.select(*node, "parts"), node).select(
        "dim", F.col("cell").alias("data_cell"), part("parts").alias("shard"), "vec_id", "q"
    )
    queries = placed.where("is_query").join(query_nodes.select(*node, "parts"), node).select(
        "dim", F.col("cell").alias("query_cell"), part("parts").alias("group"), "vec_id", "q"
    )
    pair = ["dim", "query_cell", "group", "data_cell", "shard"]

    def search(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        left = (
            queries.join(pairs, ["dim", "query_cell", "group"])
            .join(floors, "vec_id", "left")
            .select(*pair, "vec_id", "q", F.coalesce("floor", F.lit(_LOWEST)).alias("floor"))
        )
        right = data.join(pairs, ["dim", "data_cell", "shard"]).select(*pair, "vec_id", "q")
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own
        return cut(left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(_search(k), _FOUND))

    spark = vectors.sparkSession
    # the data around a query's own centre first
    both = query_nodes.select(*node, F.col("parts").alias("groups")).join(
        data_nodes.select(*node, F.col("parts").alias("shards")), node
    )
    near = both.select(
        "dim", F.col("cell").alias("query_cell"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
        F.col("cell").alias("data_cell"), "shards",
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).drop("shards")
    first = search(near, spark.createDataFrame([], "vec_id bigint, floor bigint"))
    floors = cut(
        _best(first, k).groupBy("query_id")
        .agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        .select(F.col("query_id").alias("vec_id"), "floor")
    )
    worst = (
        queries.join(floors, "vec_id", "left").groupBy("dim", "query_cell", "group")
        .agg(F.min(F.coalesce("floor", F.lit(_LOWEST))).alias("worst"))
        .join(query_nodes.withColumnRenamed("cell", "query_cell"), ["dim", "query_cell"])
        .select("dim", "query_cell", "group", "worst", "radius", "centre")
    )
    index = data_nodes.collect()  # at most CENTRES nodes for each length of vector
    nodes = spark.sparkContext.broadcast(
        {
            dim: (
                np.array([r["cell"] for r in own]), np.array([r["parts"] for r in own]),
                np.array([r["radius"] for r in own]), np.array([r["centre"] for r in own]),
            )
            for dim in {r["dim"] for r in index}
            if (own := [r for r in index if r["dim"] == dim])
        }
    )

    def surviving(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.dim not in nodes.value:
                    continue
                cells, parts, radii, centres = nodes.value[row.dim]
                bound = (
                    centres @ row.centre + row.radius * np.sqrt((centres**2).sum(axis=1))
                    + radii * np.sqrt((row.centre**2).sum()) + radii * row.radius
                )
                reach = bound + 1e-9 * (np.abs(bound) + 1) >= float(row.worst)
                for at in np.flatnonzero(reach & (cells != row.query_cell)):
                    out += [(row.dim, row.query_cell, row.group, int(cells[at]), s) for s in range(parts[at])]
            yield pd.DataFrame(out, columns=pair)

    far = worst.mapInPandas(surviving, "dim int, query_cell int, group int, data_cell int, shard int")
    return _best(first.unionByName(search(far, floors)), k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
