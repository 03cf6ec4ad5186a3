"""Essay changes as they arrive: visible at once, enriched and indexed behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType

from ..operators.embed import embed
from ..operators.essays import FIELDS, embedding_text, has_content
from ..operators.keywords import count_changes, counted_terms, document_counts, top_keywords
from ..operators.latest import latest_by
from ..operators.search import text_index
from ..schemas import ESSAY, LONG, TEXT, FLAG, struct
from ..session import cut
from ..sources.tables import VERSION, read_current, read_store, store_snapshot

STORED_ESSAY = struct(**{f.name: f.dataType for f in ESSAY}, deleted=FLAG)
QUARANTINE = struct(id=LONG, op=TEXT, reason=TEXT)
INDEXED = struct(id=LONG, deleted=FLAG)
POSTING = struct(id=LONG, term=TEXT, n_a=LONG, n_b=LONG)
#: Terms of an essay's text when it was created; ``auto`` while its keywords are made from them.
TERMS = struct(id=LONG, terms=ArrayType(struct(term=TEXT, tf=LONG)), auto=FLAG)
COUNTS = struct(term=TEXT, delta=LONG)


def terms_table(essays: str) -> str:
    return f"{essays}-terms"


def counts_table(essays: str) -> str:
    """Changes of the number of essays per term, one version per batch."""
    return f"{essays}-term-counts"


def fold_changes(changes: DataFrame) -> DataFrame:
    """One change per id: for every field the last value supplied, and the last operation.

    Works on running maxima, so an essay changed very often is combined before the shuffle.
    """

    # changes of one instant: by kind, then by content, so that a replay folds alike
    at = F.struct(
        "changed_at",
        F.when(F.col("op") == "create", 0).when(F.col("op") == "update", 1).otherwise(2).alias("kind"),
        F.xxhash64("supplied", *FIELDS).alias("content"),
    )

    def last(field: str) -> Column:
        # a create sets every field, an update those it names
        given = (F.col("op") == "create") | (
            (F.col("op") == "update") & F.coalesce(F.array_contains("supplied", field), F.lit(False))
        )
        return F.max_by(
            F.when(given, F.struct(F.col(field).alias("value"))),
            F.when(given, at),
        )

    created = F.col("op") == "create"
    gives_words = (F.col("op") == "update") & F.coalesce(F.array_contains("supplied", "keywords"), F.lit(False))
    last_words, last_create = F.max(F.when(gives_words, at)), F.max(F.when(created, at))
    return (
        changes.where("id > 0")
        .groupBy("id")
        .agg(
            *[last(f).alias(f"new_{f}") for f in FIELDS],
            F.max_by("op", at).alias("last_op"),
            F.max(created).alias("created"),
            F.max_by(F.when(created, F.struct("question", "answer")), F.when(created, at)).alias("created_text"),
            F.coalesce((last_words > last_create) | (last_words.isNotNull() & last_create.isNull()), F.lit(False))
            .alias("words_given"),
            F.max("changed_at").alias("changed_at"),
            F.min("changed_at").alias("first_at"),
        )
    )


def apply_changes(folded: DataFrame, current: DataFrame) -> DataFrame:
    """Full new rows of the changed ids; updates of unknown ids change nothing."""
    both = folded.join(current, "id", "left").where("created OR answer IS NOT NULL")
    fields = {
        f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.value")).otherwise(F.col(f))
        for f in FIELDS
    }
    return both.select(
        "id",
        *[fields[f].alias(f) for f in FIELDS],
        F.lit(None).cast(ESSAY["embedding"].dataType).alias("embedding"),
        F.coalesce("created_at", "first_at").alias("created_at"),
        F.col("changed_at").alias("updated_at"),
        (F.col("last_op") == "delete").alias("deleted"),
        "created",
        "created_text",
        "words_given",
    )


def _next_terms(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(id, before, terms, auto)`` of the essays whose terms or whose use of them change."""
    text = F.concat_ws(" ", "created_text.question", "created_text.answer")
    makes = F.col("created") & has_content("created_text.question", "created_text.answer")
    known = earlier.select("id", F.col("terms").alias("before"), F.col("auto").alias("was_auto"))
    return (
        rows.where("created OR deleted OR words_given").join(known, "id", "left")
        .select(
            "id", "before",
            F.when(~F.col("deleted"), F.when(makes, counted_terms(text)).when(~F.col("created"), F.col("before")))
            .alias("terms"),
            F.when(F.col("deleted") | F.col("words_given"), False).when(F.col("created"), makes)
            .otherwise(F.coalesce("was_auto", F.lit(False))).alias("auto"),
        )
    )


def enrich_essays(
    changes: DataFrame,
    essays: str,
    quarantine: str,
    progress: str,
    dim: int,
    make_model: Callable | None = None,
) -> StreamingQuery:
    """Apply essay changes, then fill embeddings (always) and keywords (on create).

    Keywords go by the terms of the text an essay was created with and by how many essays hold them. Both
    are tables with a version per batch: the counts are kept as changes, so a batch adds what its own essays
    change. The stored keywords are those of the batch; ``current_essays`` gives them by all
    counts so far, which do not depend on how the stream was cut into batches.

    A batch commits twice: version ``2b`` makes its essays visible without an embedding,
    version ``2b + 1`` holds the enriched rows. What cannot be enriched is recorded in the
    quarantine table and blocks nothing; an essay without answer is refused there as well.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        visible_at = 2 * batch_id
        folded = cut(fold_changes(batch))
        current = read_current(
            spark,
            essays,
            "id",
            STORED_ESSAY,
            deleted="deleted",
            before=visible_at,
            only=folded.select("id"),
        )
        rows = cut(apply_changes(folded, current.drop(VERSION)))
        valid = rows.where("answer IS NOT NULL OR deleted")
        store_snapshot(valid.select(*STORED_ESSAY.names), essays, visible_at, replay=True)
        refused = rows.where("answer IS NULL AND NOT deleted").select(
            "id", F.lit("write").alias("op"), F.lit("answer is required").alias("reason")
        )
        nameless = batch.where("op = 'create' AND coalesce(id, 0) <= 0").select(
            "id", F.lit("write").alias("op"), F.lit("a positive id is required").alias("reason")
        )
        refused = refused.unionByName(nameless)
        earlier = read_current(spark, terms_table(essays), "id", TERMS, before=batch_id, only=valid.select("id"))
        changed = cut(_next_terms(valid, earlier))
        store_snapshot(changed.select(*TERMS.names), terms_table(essays), batch_id, replay=True)
        changes = count_changes(changed.select(F.col("before").alias("terms")), changed.select("terms"))
        store_snapshot(changes, counts_table(essays), batch_id, replay=True)
        try:
            counts = document_counts(read_store(spark, counts_table(essays), COUNTS, before=batch_id + 1))
            found = top_keywords(changed.where("auto AND terms IS NOT NULL"), counts)
            rich = cut(_enrich(valid.where("NOT deleted"), found, dim, make_model))
            failed = rich.where("embedding IS NULL").select(
                "id", F.lit("embed").alias("op"), F.lit("no embedding").alias("reason")
            )
            store_snapshot(
                rich.select(*STORED_ESSAY.names), essays, visible_at + 1, replay=True
            )
        except Exception as error:  # enrichment never blocks the essays themselves
            failed = valid.where("NOT deleted").select(
                "id",
                F.lit("enrich").alias("op"),
                F.lit(f"{type(error).__name__}: {error}").alias("reason"),
            )
        store_snapshot(refused.unionByName(failed), quarantine, batch_id, replay=True)

    return (
        changes.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def _enrich(rows: DataFrame, found: DataFrame, dim: int, make_model: Callable | None) -> DataFrame:
    texts = rows.withColumn("_text", embedding_text("question", "answer", "keywords"))
    embedded = embed(texts, "_text", dim, make_model).drop("_text")
    return (
        embedded.join(found.withColumnRenamed("keywords", "_found"), "id", "left")
        .withColumn("keywords", F.coalesce("_found", "keywords"))
        .drop("_found")
    )


def current_keywords(spark: SparkSession, essays: str) -> DataFrame:
    """``(id, keywords)`` of the essays whose keywords are made from their text, by the counts so far."""
    rows = read_current(spark, terms_table(essays), "id", TERMS).where("auto AND terms IS NOT NULL")
    return top_keywords(rows, document_counts(read_store(spark, counts_table(essays), COUNTS)))


def current_essays(spark: SparkSession, essays: str) -> DataFrame:
    rows = read_current(spark, essays, "id", STORED_ESSAY, deleted="deleted").drop(VERSION)
    found = current_keywords(spark, essays).withColumnRenamed("keywords", "_found")
    return (
        rows.join(found, "id", "left")
        .withColumn("keywords", F.coalesce("_found", "keywords"))
        .select(*rows.columns)
    )


def index_on_write(
    essays: DataFrame, postings: str, indexed: str, progress: str
) -> StreamingQuery:
    """Postings of every written essay; ``essays`` streams full rows with ``deleted``.

    A batch adds the postings of its own essays only. Which version of an essay counts is
    kept apart, so older postings need not be rewritten.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = latest_by(batch, ["id"], ["updated_at"])
        rows = cut(rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))))
        store_snapshot(text_index(rows.where("NOT deleted")), postings, batch_id, replay=True)
        store_snapshot(rows.select("id", "deleted"), indexed, batch_id, replay=True)

    return (
        essays.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def current_postings(spark: SparkSession, postings: str, indexed: str) -> DataFrame:
    """Postings of the newest version of every essay that is not deleted."""
    newest = latest_by(read_store(spark, indexed, INDEXED), ["id"], [VERSION])
    live = newest.where("NOT deleted").select("id", VERSION)
    return read_store(spark, postings, POSTING).join(live, ["id", VERSION], "left_semi").drop(VERSION)
