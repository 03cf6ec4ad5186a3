"""Which incoming postings the store already knows, and what storing a batch does.

"Same id OR same URL OR same active title and company" as one join condition has no equi-key
and plans a nested loop. Here every rule is a probe ``(kind, scope, value)``: a row asks one
probe per rule, a stored row answers with its ids, URLs and titles, and a single equi-join
matches them. The scope is the row's source, or any source, so the source rule is part of the
key; answers are distinct, so a key with many stored rows cannot multiply work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..session import written
from .dedupe import (
    dedupe_batch,
    first_by_id,
    first_by_url,
    losers,
    narrow_keys,
    sorted_side,
    url_scopes,
    with_first,
)

#: Rules by name: the kind of key and whether the row's source restricts the match.
BY_ID, BY_URL = ("id", True), ("url", True)
ID_ANYWHERE, URL_ANYWHERE = ("id", False), ("url", False)
ACTIVE = ("active", False)

#: Rows of a written batch whose asked values are broadcast: a few probes each, so some tens of megabytes.
FEW = 50_000


def utc(now: str, column: str, df: DataFrame) -> Column:
    """``now`` (UTC text) as a constant of the type of ``df[column]``, so filters push down."""
    return F.lit(now).cast(df.schema[column].dataType)


def _scope(source: Column | None) -> Column:
    """``*`` for any source, ``=name`` for one."""
    any_source = F.lit("*")
    if source is None:
        return any_source
    return F.coalesce(F.concat(F.lit("="), blank_to_null(source)), any_source)


def _title_key(title: Column, company: Column) -> Column:
    """Title and company as one text; the length keeps the border between them."""
    both = blank_to_null(title).isNotNull() & blank_to_null(company).isNotNull()
    return F.when(both, F.concat_ws(":", F.length(title).cast("string"), title, company))


def known_flags(
    keys: DataFrame,
    store: DataFrame,
    rules: Mapping[str, tuple[str, bool]],
    order: str = "arrival",
    now: str | None = None,
    few: bool = False,
) -> DataFrame:
    """``(order, one flag per rule)`` for the rows that at least one rule recognises.

    ``keys`` has ``external_id``, ``source_url``, ``source`` and, for the active rule,
    ``title`` and ``company_name``. The store is read once and narrowed to the asked values; those
    of ``few`` rows are broadcast to that scan, before anything of it is shuffled. All others meet it sorted:
    by the size of a compressed table they would be gathered on the driver long after they stopped fitting there.
    """

    def values(df: DataFrame, live: Column) -> dict[str, Column]:
        kinds = {kind for kind, _ in rules.values()}
        found = {
            "id": lambda: blank_to_null(F.col("external_id").cast("string")),
            "url": lambda: blank_to_null("source_url"),
            "active": lambda: F.when(live, _title_key(F.col("title"), F.col("company_name"))),
        }
        return {kind: found[kind]() for kind in sorted(kinds)}

    asked = values(keys, F.lit(True))
    probes = keys.select(
        order,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(rule).alias("rule"),
                        F.lit(kind).alias("kind"),
                        _scope(F.col("source") if scoped else None).alias("scope"),
                        asked[kind].alias("value"),
                    )
                    for rule, (kind, scoped) in rules.items()
                ]
            )
        ).alias("p"),
    ).select(order, "p.*").where("value IS NOT NULL")
    wanted = probes.select("kind", "value").distinct()

    live = F.lit(True)
    if now is not None:
        live = F.col("expires_at").isNull() | (
            F.col("expires_at") >= utc(now, "expires_at", store)
        )
    answers = [
        F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        for kind, value in values(store, live).items()
    ]
    known = (
        store.select(
            _scope(F.col("source")).alias("_own"), F.explode(F.array(*answers)).alias("a")
        )
        .select("_own", "a.*")
        .where("value IS NOT NULL")
        .join(F.broadcast(wanted) if few else sorted_side(wanted), ["kind", "value"], "left_semi")
        .select("kind", "value", F.explode(F.array(F.lit("*"), F.col("_own"))).alias("scope"))
        .distinct()
    )
    hits = probes.join(sorted_side(known), ["kind", "scope", "value"], "left_semi")
    return hits.groupBy(order).agg(
        *[F.max(F.col("rule") == rule).alias(rule) for rule in rules]
    )


def attach_flags(
    incoming: DataFrame, flags: DataFrame, names: Mapping[str, object], order: str
) -> DataFrame:
    """Bring the (few) recognised rows back to the wide ones."""
    joined = incoming.join(flags, order, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def find_existing(incoming: DataFrame, store: DataFrame, order: str = "arrival") -> DataFrame:
    """Add ``known_by_id`` and ``known_by_url``, both source-aware, and ``exists``."""
    rules = {"known_by_id": BY_ID, "known_by_url": BY_URL}
    keys = incoming.select(order, "external_id", "source_url", "source")
    out = attach_flags(incoming, known_flags(keys, store, rules, order), rules, order)
    return out.withColumn("exists", F.col("known_by_id") | F.col("known_by_url"))


def active_title_company(
    incoming: DataFrame, store: DataFrame, now: str, order: str = "arrival"
) -> DataFrame:
    """Add ``active``: an unexpired stored job has the same title and company."""
    rules = {"active": ACTIVE}
    keys = incoming.select(order, "title", "company_name", "source")
    return attach_flags(incoming, known_flags(keys, store, rules, order, now), rules, order)


def is_existing_job(
    incoming: DataFrame, store: DataFrame, now: str, order: str = "arrival"
) -> DataFrame:
    """Add ``existing``: known by id (of the same source when the job has one) or active.

    The id comes from ``job_id``, else ``external_id``; the company from the nested struct,
    else ``company_name``.
    """
    names = incoming.columns
    ids = [F.col(c).cast("string") for c in ("job_id", "external_id") if c in names]
    companies = [
        blank_to_null(c)
        for c in ("company.name", "company_name")
        if c.split(".")[0] in names
    ]
    keys = incoming.select(
        order,
        F.coalesce(*ids).alias("external_id"),
        "source",
        "title",
        F.coalesce(*companies).alias("company_name"),
    )
    rules = {"_by_id": BY_ID, "_active": ACTIVE}
    out = attach_flags(incoming, known_flags(keys, store, rules, order, now), rules, order)
    return out.withColumn("existing", F.col("_by_id") | F.col("_active")).drop(*rules)


def insert_new_jobs(
    incoming: DataFrame,
    store: DataFrame,
    order: str = "arrival",
) -> DataFrame:
    """Outcome of inserting the batch row by row in ``order``.

    ``stored``; ``duplicate`` when a stored or earlier inserted job matches with the source
    rule; ``integrity_error`` when only the globally unique external id clashes. The store is
    consulted first: a row it blocks is never inserted and so blocks no later row.
    """
    keys = written(incoming.select(order, "external_id", "source_url", "source"), "keys")
    rules = {"_dup_id": BY_ID, "_dup_url": BY_URL, "_clash": ID_ANYWHERE}
    found = known_flags(keys, store, rules, order, few=keys.count() <= FEW)
    flags = attach_flags(keys, found, rules, order)
    against_store = (
        F.when(F.col("_dup_id") | F.col("_dup_url"), "duplicate")
        .when(F.col("_clash"), "integrity_error")
    )
    checked = written(flags.select(*keys.columns, against_store.alias("outcome")), "checked")
    fresh = checked.where("outcome IS NULL").drop("outcome")
    tight = narrow_keys(fresh, order, "external_id", "source_url", "source")
    out = written(losers(tight), "losers")
    won = tight.join(out, "pos", "left_anti")
    # an id the store holds elsewhere still loses to an inserted job with its URL first
    clashing = checked.where("outcome = 'integrity_error'")
    lost = tight.join(out, "pos", "left_semi").unionByName(
        narrow_keys(clashing, order, "external_id", "source_url", "source")
    )
    # an id clash is a plain duplicate when the kept job has the row's source, or it has none
    id_scope = (
        won.where("id IS NOT NULL")
        .select("id", F.explode(url_scopes("id", "source")).alias("_scope"))
        .distinct()
        .withColumnsRenamed({"id": "_id"})
    )
    by_url = first_by_url(won, "won_url")
    reasons = (
        with_first(lost, first_by_id(won, "won_id"), by_url)
        .join(
            id_scope.withColumn("_same", F.lit(True)),
            (F.col("id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_scope")),
            "left",
        )
        .select(
            F.col("pos").alias(order),
            F.when(
                F.coalesce("_same", F.lit(False))
                | F.coalesce(F.col("won_url") < F.col("pos"), F.lit(False)),
                "duplicate",
            )
            .otherwise("integrity_error")
            .alias("outcome"),
        )
    )
    refused = checked.where("outcome = 'duplicate'").select(order, "outcome").unionByName(reasons)
    return incoming.join(refused, order, "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("stored"))
    )


def save_rejected(
    rejected: DataFrame,
    store: DataFrame,
    order: str = "arrival",
) -> DataFrame:
    """Rejected jobs to add to the store, flagged filtered and not relevant.

    A job whose id or URL is stored under any source is skipped; inside the batch the first
    arrival wins. The saved count is the row count of the result.
    """
    keys = written(rejected.select(order, "external_id", "source_url", "source"), "keys")
    rules = {"_by_id": ID_ANYWHERE, "_by_url": URL_ANYWHERE}
    stored = known_flags(keys, store, rules, order, few=keys.count() <= FEW).select(order)
    fresh = written(keys.join(sorted_side(stored), order, "left_anti"), "fresh")
    kept = dedupe_batch(fresh, order).where("kept").select(order)
    return rejected.join(sorted_side(kept), order, "left_semi").withColumns(
        {"is_filtered": F.lit(True), "is_relevant": F.lit(False)}
    )
