"""Near-duplicate vectors: exact metric range join on unit vectors, label by label.

A cosine of at least ``c`` is a distance of at most ``r = sqrt(2 - 2c)`` between unit vectors. Pivots divide the vectors of a
label into cells (nearest pivot). A vector has to be looked for in another cell only if the triangle
inequality allows a partner there: its distance to the pivot is at most the radius of the cell plus r, and
it lies within r of the plane half way between the pivots. It is copied to those cells, and cells join
independently. Rows of a cell beyond ``BLOCK`` are joined block by block, so a task holds two blocks at most
however hot a cell is. A task returns the number of links of its rows and a spanning forest,
never the pairs. Equal vectors of a label meet first and take part once, with their count.

Pivots come from a bounded sample and number ``MAX_PIVOTS`` at most, which bounds their broadcast;
labels up to ``CELL`` vectors need none. Vectors in high dimension without clusters lie close to many planes: then most vectors visit most cells
and the work is that of comparing all vectors of a label, in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing; vectors of different length never link; equal rows link with each other;
ids may repeat, each row counts. Other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import Forest, components
from .vectors import farthest_first, usable

CELL = 4096
BLOCK = 4096
MAX_PIVOTS = 4096
SAMPLE = 32_768
_SLACK = 1e-9
_ROWS = 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def classes_of(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row: ``class, label, embedding, dim, least_id, copies``."""
    zero = F.forall("embedding", lambda x: x == 0)
    return cut(
        vectors.where(F.col("label").isNotNull() & usable("embedding") & ~zero)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("class", F.monotonically_increasing_id())
    )


def choose_pivots(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of every (label, length) with more than ``CELL`` vectors."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cell = max(CELL, total / MAX_PIVOTS)
    large = sizes.where(F.col("n") > cell).collect()  # at most MAX_PIVOTS rows
    wanted = {(r["label"], r["dim"]): int(np.ceil(r["n"] / cell)) for r in large}
    if not wanted:
        return {}
    keys = classes.sparkSession.createDataFrame([tuple(k) for k in wanted], "label int, dim int")
    order = F.xxhash64("class")
    drawn = (
        classes.join(F.broadcast(keys), ["label", "dim"])
        .orderBy(order).limit(SAMPLE)  # the sample only places the pivots
        .select("label", "dim", "embedding").toPandas()
    )
    pivots = {}
    for key, rows in drawn.groupby(["label", "dim"]):
        points = _unit(_matrix(rows["embedding"]))
        key = tuple(int(k) for k in key)
        pivots[key] = points[farthest_first(points, wanted[key])]
    return pivots


def _nearest(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    products = units @ pivots.T
    return np.argmax(products, axis=1), products


def _own_cells(pivots: dict):
    @F.pandas_udf("cell int, distance double")
    def own(labels: pd.Series, dims: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.zeros(len(labels), dtype=np.int32), "distance": 0.0})
        for key, at in pd.Series(range(len(labels))).groupby([labels.to_numpy(), dims.to_numpy()]):
            if key in pivots.value:
                units = _unit(_matrix(vectors.iloc[at]))
                cell, products = _nearest(units, pivots.value[key])
                best = products[np.arange(len(units)), cell]
                out.loc[at, "cell"] = cell.astype(np.int32)
                out.loc[at, "distance"] = np.sqrt(np.maximum(2 - 2 * best, 0))
        return out

    return own


def _visited_cells(pivots: dict, radii: dict, radius: float):
    @F.pandas_udf("array<int>")
    def visits(labels: pd.Series, dims: pd.Series, vectors: pd.Series) -> pd.Series:
        out = [[0]] * len(labels)
        for key, at in pd.Series(range(len(labels))).groupby([labels.to_numpy(), dims.to_numpy()]):
            if key not in pivots.value:
                continue
            centres, covering = pivots.value[key], radii.value[key]
            cell, products = _nearest(_unit(_matrix(vectors.iloc[at])), centres)
            apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
            own = products[np.arange(len(cell)), cell]
            plane = own[:, None] - products <= radius * apart[cell] + _SLACK
            ball = np.sqrt(np.maximum(2 - 2 * products, 0)) <= covering + radius + _SLACK
            goes = plane & ball
            goes[np.arange(len(cell)), cell] = True
            for row, k in enumerate(at):
                out[k] = np.flatnonzero(goes[row]).tolist()
        return pd.Series(out, dtype=object)

    return visits


def _join_blocks(least_cosine: float):
    def join(home: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """Links of the home rows with the others: counts per home class, and forest edges."""
        if home.empty or others.empty:
            return pd.DataFrame({"class": [], "other": [], "n": []}).astype("int64")
        a, b = _unit(_matrix(home["embedding"])), _unit(_matrix(others["embedding"]))
        ids, other_ids = home["class"].to_numpy(), others["class"].to_numpy()
        copies = others["copies"].to_numpy(dtype=np.float64)
        forest = Forest(len(ids) + len(other_ids))
        counts = np.zeros(len(ids), dtype=np.int64)
        for start in range(0, len(ids), _ROWS):
            near = a[start : start + _ROWS] @ b.T >= least_cosine
            near &= ids[start : start + _ROWS, None] != other_ids[None]
            counts[start : start + _ROWS] = np.rint(near @ copies)
            for row in np.flatnonzero(near.any(axis=1)):
                forest.link(start + row, len(ids) + np.flatnonzero(near[row]))
        left, right = forest.edges()
        every = np.concatenate([ids, other_ids])
        linked = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "class": np.concatenate([ids[linked], every[left]]),
                "other": np.concatenate([np.full(len(linked), -1), every[right]]),
                "n": np.concatenate([counts[linked], np.zeros(len(left), dtype=np.int64)]),
            }
        )

    return join


def near_vectors(vectors: DataFrame, least_cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``."""
    vectors = vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    classes = classes_of(vectors)
    context = vectors.sparkSession.sparkContext
    radius = float(np.sqrt(2 - 2 * least_cosine))
    found_pivots = choose_pivots(classes)
    pivots = context.broadcast(found_pivots)
    key = ["label", "dim", "embedding"]
    homes = cut(
        classes.withColumn("_own", _own_cells(pivots)(*key)).select("*", "_own.*").drop("_own")
    )
    cells = cut(
        homes.groupBy("label", "dim", "cell").agg(F.count("*").alias("rows"), F.max("distance").alias("reach"))
    )
    radii = {k: np.full(len(p), -np.inf) for k, p in found_pivots.items()}  # a cell may be empty
    reached = cells.join(
        F.broadcast(vectors.sparkSession.createDataFrame(list(radii) or [(-1, -1)], "label int, dim int")),
        ["label", "dim"],
    )
    for r in reached.collect():  # at most MAX_PIVOTS rows
        if (r["label"], r["dim"]) in radii:
            radii[r["label"], r["dim"]][r["cell"]] = r["reach"]
    visits = _visited_cells(pivots, context.broadcast(radii), radius)

    def blocks(rows: str):
        return F.ceil(F.col(rows) / BLOCK).cast("int")

    def salted(n: str):
        return F.pmod(F.xxhash64("class"), F.col(n)).cast("int")

    visitors = cut(homes.drop("cell", "distance").withColumn("cell", F.explode(visits(*key))))
    met = visitors.groupBy("label", "dim", "cell").agg(F.count("*").alias("visiting"))
    shape = cut(
        cells.join(met, ["label", "dim", "cell"])
        .select("label", "dim", "cell", blocks("rows").alias("n_a"), blocks("visiting").alias("n_b"))
    )
    group = ["label", "dim", "cell", "block_a", "block_b"]
    home_side = (
        homes.join(shape, ["label", "dim", "cell"])
        .withColumn("block_a", salted("n_a"))
        .withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
        .select(*group, "class", "embedding")
    )
    other_side = (
        visitors.join(shape, ["label", "dim", "cell"])
        .withColumn("block_b", salted("n_b"))
        .withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)))
        .select(*group, "class", "embedding", "copies")
    )
    home_side, other_side = (s.toDF(*s.columns) for s in (home_side, other_side))  # columns of their own
    joined = cut(
        home_side.groupBy(*group)
        .cogroup(other_side.groupBy(*group))
        .applyInPandas(_join_blocks(least_cosine), "class bigint, other bigint, n bigint")
    )
    counts = joined.where("other = -1").groupBy("class").agg(F.sum("n").alias("linked"))
    found = components(
        joined.where("other <> -1").select(F.col("class").alias("a"), F.col("other").alias("b"))
    ).withColumnRenamed("node", "class")
    rooted = (
        classes.join(found, "class", "left").join(counts, "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    done = cut(
        rooted.join(named, "root").select(
            F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "component_id",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    component = F.coalesce("component_id", "vec_id")
    return vectors.join(
        done,
        (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")),
        "left",
    ).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a
  JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), named AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT n.vec_id, (SELECT count(*) FROM links l WHERE l.x = n.vec_id) AS n_links, n.component_id,
       n.vec_id = n.component_id AS kept
FROM named n
"""
