"""Search as a user asks for it: a text, embedded and answered with readable hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.text import strip
from ..operators.embed import embed
from ..operators.essays import search_preview
from ..operators.search import hybrid_search


def search_essays(
    essays: DataFrame,
    queries: DataFrame,
    dim: int,
    limit: int = 10,
    vector_weight: float = 0.5,
    make_model: Callable | None = None,
) -> DataFrame:
    """Ranked hits of ``queries (query_id, text)`` with a ``preview``.

    The query is trimmed and embedded like the essays were. Only keys and vectors take part in
    the search; question and answer are joined to the final hits.
    """
    asked = embed(queries.withColumn("text", strip("text")), "text", dim, make_model)
    hits = hybrid_search(essays, asked, limit, vector_weight)
    shown = essays.select("id", search_preview().alias("preview"))
    return hits.join(shown, "id").select(*hits.columns, "preview")
