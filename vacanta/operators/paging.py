"""Pages of a table, newest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paginate(
    df: DataFrame, page: int, page_size: int, order: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """One page with ``total_count`` and ``total_pages`` (at least 1); page <= 0 is page 1."""
    page = max(page, 1)
    newest = [F.col(c).desc() for c in order]
    rows = df.orderBy(*newest).offset((page - 1) * page_size).limit(page_size)
    total = df.agg(F.count("*")).scalar()
    pages = F.greatest(F.ceil(total / F.lit(page_size)), F.lit(1))
    return rows.withColumns(
        {"total_count": total.cast("bigint"), "total_pages": pages.cast("bigint")}
    )


def page_after(
    df: DataFrame, after: Sequence, page_size: int, order: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """The page after the row whose order columns are ``after``: deep pages skip nothing."""
    first, *rest = order
    bound, *rest_bounds = after
    seek = F.col(first) < F.lit(bound)
    tie = F.col(first) == F.lit(bound)
    for name, value in zip(rest, rest_bounds):
        seek = seek | (tie & (F.col(name) < F.lit(value)))
        tie = tie & (F.col(name) == F.lit(value))
    return df.where(seek).orderBy(*[F.col(c).desc() for c in order]).limit(page_size)
