"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

A pair within ``RADIUS`` = 3 bits differs by at most 1 bit in one half of the fingerprint, so there is
one tree per half. A node splits by the Hamming distance of some bits to a vantage point: half the
bits with bound 1, or all bits with bound 3. By the triangle inequality a fingerprint has to be looked for on both sides only if its distance lies within the
bound of the split. Every fingerprint is at home in one leaf of each tree and visits the
leaves whose region its ball touches; a leaf compares its home fingerprints with all that came, on
all 64 bits, and gives out a spanning forest of what it links, so a dense group costs as many
edges as it has members. A leaf of more than ``LEAF_BLOCK`` rows is compared block by block, a task each. Copies meet first: trees, leaves and edges see distinct
fingerprints only.

The trees are fitted on a bounded sample (``SAMPLE`` distinct fingerprints at most, an eighth at
most); every fingerprint is indexed and the links are exact. Their size is that of the number
of leaves.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; a text of fewer words than a shingle is
one shingle; words repeat freely. A null id is never the name of a component unless all of its ids are null. Other columns are kept by
``fingerprint``; a column with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import PIECE, word_pieces, written
from .components import Forest, components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints at home in a leaf, roughly; fingerprints the trees are fitted on, at most.
LEAF = 2048
SAMPLE = 1 << 16
#: A split that sends a larger share of the rows to both sides is not made.
MOST_SHARED = 0.7
#: Fingerprints of a leaf that one task compares with as many; larger leaves meet block by block.
LEAF_BLOCK = 1 << 14
_SPACES = r" \t\n\x0b\x0c\r"
_VANTAGES = 24
_BLOCK = 256
_STEP = 1 << 15


def _bit_sums(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How many of the shingles of ``words`` set each bit (highest first), and their number."""
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)]))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n
    ).astype(">u8")
    sums = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _STEP):
        octets = hashes[start : start + _STEP].view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return sums, n


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint as a signed number."""
    sums, total = np.zeros(64, dtype=np.int64), 0
    words: list[bytes] = []
    for piece in word_pieces(text, PIECE, _SPACES) if text else ():
        words += piece.encode("utf-8", "replace").lower().split()  # bytes: ASCII only, as defined
        if len(words) >= SHINGLE:
            found, n = _bit_sums(words)
            sums, total = sums + found, total + n
            words = words[len(words) - SHINGLE + 1 :]
    if not total and words:
        whole = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return int(np.uint64(whole).astype(np.int64))
    return int.from_bytes(np.packbits(2 * sums > total).tobytes(), "big", signed=True)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` (bigint)."""

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(None if pd.isna(t) else t) for t in texts], dtype="int64")

    return docs.withColumn("fingerprint", hashed(F.col(text)))


_ALL = 0xFFFFFFFFFFFFFFFF
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)


@dataclass
class Tree:
    """Inner nodes as arrays; a child below 0 is the leaf ``-1 - child``."""

    mask: list[int]
    vantage: list[int]
    bound: list[int]
    split: list[int]
    children: list[tuple[int, int]]
    root: int = -1
    leaves: int = 1


def _best_split(points: np.ndarray, metrics, rng):
    """The split with the least work: pairs to compare, those that meet on both sides included."""
    best = None
    for mask, bound in metrics:
        vantages = points[rng.integers(0, len(points), _VANTAGES)]
        flips = rng.integers(0, 1 << 63, _VANTAGES, dtype=np.uint64)
        vantages[::2] ^= flips[::2] & flips[1::2]  # half of them off the data
        distances = np.bitwise_count((points[:, None] ^ vantages[None]) & np.uint64(mask))
        for k in range(_VANTAGES):
            seen = np.bincount(distances[:, k], minlength=65)
            left = np.cumsum(seen)
            for split in range(64):
                inside = left[split] / len(points)
                if not 0.1 <= inside <= 0.9:
                    continue
                low = left[split - bound] if split >= bound else 0
                shared = (left[min(split + bound, 64)] - low) / len(points)
                to_left = left[min(split + bound, 64)] / len(points)
                to_right = 1 - low / len(points)
                work = inside * to_left + (1 - inside) * to_right
                if shared <= MOST_SHARED and (best is None or work < best[0]):
                    best = (work, mask, bound, int(vantages[k]), split, distances[:, k])
    return best


def fit_tree(sample: np.ndarray, half: int, leaf: float) -> Tree:
    """A tree whose leaves hold about ``leaf`` of the sampled fingerprints."""
    tree = Tree([], [], [], [], [], leaves=0)
    rng = np.random.default_rng(half & 0xFFFF)
    metrics = ((half, 1), (_ALL, RADIUS))

    def grow(points: np.ndarray) -> int:
        found = _best_split(points, metrics, rng) if len(points) > max(leaf, 32) else None
        if found is None:
            tree.leaves += 1
            return -tree.leaves
        _, mask, bound, vantage, split, distances = found
        at = len(tree.mask)
        for column, value in zip((tree.mask, tree.vantage, tree.bound, tree.split), (mask, vantage, bound, split)):
            column.append(value)
        tree.children.append((0, 0))
        inside = distances <= split
        tree.children[at] = (grow(points[inside]), grow(points[~inside]))
        return at

    tree.root = grow(sample)
    return tree


def route(tree: Tree, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(leaf, indices of points, whether at home)`` for every leaf that some point visits."""
    waiting = [(tree.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while waiting:
        node, at, home = waiting.pop()
        if not len(at):
            continue
        if node < 0:
            yield -1 - node, at, home
            continue
        masked = (points[at] ^ np.uint64(tree.vantage[node])) & np.uint64(tree.mask[node])
        distance = np.bitwise_count(masked).astype(np.int64)
        inside = distance <= tree.split[node]
        for child, own, goes in (
            (tree.children[node][0], inside, distance - tree.bound[node] <= tree.split[node]),
            (tree.children[node][1], ~inside, distance + tree.bound[node] > tree.split[node]),
        ):
            waiting.append((child, at[goes], (home & own)[goes]))


def link_leaf(points: np.ndarray, home: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between the points ``home`` and the points ``other`` of a leaf."""
    forest = Forest(len(points))
    members, others = np.flatnonzero(home), np.flatnonzero(other)
    for start in range(0, len(members), _BLOCK):
        block = members[start : start + _BLOCK]
        near = np.bitwise_count(points[block][:, None] ^ points[others][None]) <= RADIUS
        for row in np.flatnonzero(near.sum(axis=1) > other[block]):  # more than itself
            forest.link(block[row], others[near[row]])
    left, right = forest.edges()
    return points[left], points[right]


def _link(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("fingerprint")
    points = frame["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
    a, b = link_leaf(points, frame["as_home"].to_numpy(dtype=bool), frame["as_other"].to_numpy(dtype=bool))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _in_blocks(placed: DataFrame, size: int) -> DataFrame:
    """Every row in all pairs of blocks it takes part in, as one of the home or of the other rows, or both.

    Home rows of a leaf fall into ``n_home`` blocks and all its rows into ``n_other``; a leaf of usual size has
    one of each, and none of its rows is sent twice.
    """
    leaf = ["tree", "leaf"]
    large = written(
        placed.groupBy(*leaf).agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_other"))
        .where(F.col("n_other") > size)
        .select(*leaf, *[F.ceil(F.col(c) / size).cast("int").alias(c) for c in ("n_home", "n_other")]),
        "leaves",
    )
    dealt = placed.join(large, leaf, "left").withColumns(
        {
            c: F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64("fingerprint"), F.col(n))).cast("int")
            for c, n in (("home_block", "n_home"), ("other_block", "n_other"))
        }
    )
    last = {n: F.coalesce(n, F.lit(1)) - 1 for n in ("n_home", "n_other")}

    def pair(home: Column, other: Column) -> Column:
        return F.struct(home.cast("int").alias("home_block"), other.cast("int").alias("other_block"))

    own = F.transform(F.sequence(F.lit(0), last["n_other"]), lambda k: pair(F.col("home_block"), k))
    met = F.transform(F.sequence(F.lit(0), last["n_home"]), lambda k: pair(k, F.col("other_block")))
    pairs = F.array_distinct(F.when(F.col("home"), F.concat(own, met)).otherwise(met))
    return dealt.select("*", F.explode(pairs).alias("p")).select(
        *leaf, "p.home_block", "p.other_block", "fingerprint",
        (F.col("home") & (F.col("p.home_block") == F.col("home_block"))).alias("as_home"),
        (F.col("p.other_block") == F.col("other_block")).alias("as_other"),
    )


def links(distinct: DataFrame, leaf: int = LEAF, sample: int = SAMPLE, block: int = LEAF_BLOCK) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what chains of links within ``RADIUS`` connect.

    ``distinct`` holds every fingerprint once, in ``fingerprint``.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    order = F.xxhash64("fingerprint")
    drawn = (
        distinct.where(F.pmod(order, F.lit(8)) == 0)
        .orderBy(order, "fingerprint").limit(sample)  # bounded sample that shapes the trees only
        .select("fingerprint").toPandas()["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
    )
    share = leaf * len(drawn) / max(rows, 1)
    trees = spark.sparkContext.broadcast([fit_tree(drawn, half, share) for half in HALVES])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
            for number, tree in enumerate(trees.value):
                for leaf, at, home in route(tree, points):
                    yield pd.DataFrame(
                        {
                            "tree": np.full(len(at), number, dtype=np.int32),
                            "leaf": np.full(len(at), leaf, dtype=np.int32),
                            "fingerprint": points[at].view(np.int64),
                            "home": home,
                        }
                    )

    placed = written(
        distinct.select("fingerprint").mapInPandas(place, "tree int, leaf int, fingerprint bigint, home boolean"),
        "placed",
    )
    group = ["tree", "leaf", "home_block", "other_block"]
    return _in_blocks(placed, block).groupBy(*group).applyInPandas(_link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fingerprint, root, component_id)`` of every row.

    ``root`` is the smallest fingerprint of the component, ``component_id`` its smallest id;
    ``text_hash`` (xxhash64 of the text) tells rows of one id apart.
    """
    narrow = cut(
        fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "fingerprint")
    )
    distinct = cut(narrow.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    found = components(links(distinct)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(found, "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return narrow.join(rooted.join(named, "root").drop("least_id"), "fingerprint")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component: that of the smallest id, and of its texts that of the smallest hash."""
    key = ["doc_id", "text_hash"]
    names = {c: _free(docs, f"_kept_{c}") for c in key}
    kept = (
        near_duplicates(docs, doc_id, text)
        .groupBy("root")
        .agg(
            # nulls last: a null id stays only where there is no other
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *key)).alias("best")
        )
        .select(*[F.col(f"best.{c}").alias(names[c]) for c in key])
    )
    own = _free(docs, "_text_hash")
    marked = docs.withColumn(own, F.xxhash64(text))
    return (
        marked.join(
            kept,
            F.col(doc_id).eqNullSafe(F.col(names["doc_id"])) & (F.col(own) == F.col(names["text_hash"])),
            "left_semi",
        )
        .dropDuplicates([doc_id, own])
        .drop(own)
    )


def _free(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
