"""Questions asked of the job store."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .known import utc

# Fixed value: how far back an automatic search may look.
MAX_AUTO_DAYS = 5


def days_before(now: str, days: float) -> str:
    return str(datetime.fromisoformat(now) - timedelta(days=days))


def existing_urls(store: DataFrame, source: str, days: int | None, now: str) -> DataFrame:
    """URLs stored for one source, optionally posted in the last ``days``; copies are kept."""
    rows = store.where((F.col("source") == source) & F.col("source_url").isNotNull())
    if days is not None:
        rows = rows.where(F.col("posted_at") >= utc(days_before(now, days), "posted_at", store))
    return rows.select("source_url")


def lookup_external_id(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored rows for ``(external_id, source)`` keys; a key without source matches any."""
    wanted = keys.select(
        F.col("external_id").alias("_id"), blank_to_null("source").alias("_source")
    )
    same = F.col("_source").isNull() | (F.col("source") == F.col("_source"))
    return store.join(wanted, (F.col("external_id") == F.col("_id")) & same, "left_semi")


def latest_updated(store: DataFrame) -> DataFrame:
    """One row: the newest ``updated_at``, NULL for an empty store."""
    return store.agg(F.max("updated_at").alias("latest_updated_at"))


def posted_after_cutoff(store: DataFrame, days: int | None, now: str) -> DataFrame:
    """One row: where a search starts, ``now - days`` or the newest update, at most 5 days back."""
    kind = store.schema["updated_at"].dataType
    if days is not None:
        start = F.lit(days_before(now, days)).cast(kind)
        return store.sparkSession.range(1).select(start.alias("posted_after"))
    floor = F.lit(days_before(now, MAX_AUTO_DAYS)).cast(kind)
    return store.agg(
        F.greatest(F.coalesce(F.max("updated_at"), floor), floor).alias("posted_after")
    )
