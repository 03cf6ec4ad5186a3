"""Latest row per key, and key-replacing upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``.

    ``row_number() = 1`` plans a window group limit that keeps one row per key in every map
    task before the shuffle, so a key that holds most rows does not reach one task whole.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    )


def upsert_latest(
    base: DataFrame,
    incoming: DataFrame,
    key: str,
    order: str,
    update_only: bool = False,
) -> DataFrame:
    """Replace the rows of ``base`` by newer incoming rows of the same key.

    ``update_only`` fails the query for an incoming key the base does not hold.
    """
    if update_only:
        known = base.select(F.col(key).alias("_known")).distinct()
        found = F.coalesce(
            F.col("_known"),
            F.raise_error(
                F.concat(F.lit("Cannot update unknown key: "), F.col(key).cast("string"))
            ).cast(base.schema[key].dataType),
        )
        incoming = (
            incoming.join(known, F.col(key) == F.col("_known"), "left")
            .withColumn(key, found)
            .drop("_known")
        )
    rows = base.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return latest_by(rows, [key], [order, "_side"]).drop("_side")
