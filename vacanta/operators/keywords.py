"""Keywords of an essay: its terms of highest TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import counted, normalise_keywords
from ..functions.text import is_stop_word, tokens
from ..session import written

MAX_KEYWORDS = 10


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)`` without stop words; counts combine inside the map task."""
    return (
        docs.select(key, F.explode(tokens(text)).alias("term"))
        .where(~is_stop_word("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def extract_keywords(
    docs: DataFrame, key: str = "id", text: str = "text", n: int = MAX_KEYWORDS
) -> DataFrame:
    """``(key, keywords)``: the top ``n`` terms; documents without terms have no row.

    Both sides of the join with the document counts are written, so that adaptive execution
    can split the rows of a frequent term.
    """
    # read three times below; written once so that no text is tokenised again
    tf = written(term_counts(docs, key, text), "terms")
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")), "documents")
    total = docs.agg(F.count("*")).scalar()
    rated = tf.join(df, "term").withColumn(
        "score",
        F.round(F.col("tf") * (F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0), 9),
    )
    return _best_terms(rated, key, n)


def counted_terms(text: Column) -> Column:
    """``array<struct<term, tf>>`` of one text without stop words, counted inside the row."""
    return counted(F.sort_array(F.filter(tokens(text), lambda t: ~is_stop_word(t))))


def document_counts(deltas: DataFrame) -> DataFrame:
    """``(term, df)`` from changes of document counts; the empty term counts the documents."""
    return deltas.groupBy("term").agg(F.sum("delta").alias("df")).where("df > 0")


def count_changes(before: DataFrame, after: DataFrame, terms: str = "terms") -> DataFrame:
    """``(term, delta)``: what replacing the documents ``before`` by ``after`` does to document counts.

    Changes add up in any order and any grouping, so counts kept as a table of changes are the same for one
    batch and for many.
    """

    def held(rows: DataFrame, sign: int) -> DataFrame:
        names = F.concat(F.array(F.lit("")), F.col(f"{terms}.term"))
        return rows.where(F.col(terms).isNotNull()).select(
            F.explode(names).alias("term"), F.lit(sign).cast("bigint").alias("delta")
        )

    changes = held(after, 1).unionByName(held(before, -1))
    return changes.groupBy("term").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def top_keywords(rows: DataFrame, counts: DataFrame, key: str = "id", n: int = MAX_KEYWORDS) -> DataFrame:
    """``(key, keywords)`` of rows with counted ``terms``, by the document counts of a whole corpus."""
    total = F.coalesce(counts.where("term = ''").agg(F.max("df")).scalar(), F.lit(0))
    rated = (
        rows.select(key, F.inline("terms"))
        .join(counts.where("term <> ''"), "term")
        .withColumn(
            "score", F.round(F.col("tf") * (F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0), 9)
        )
    )
    return _best_terms(rated, key, n)


def _best_terms(rated: DataFrame, key: str, n: int) -> DataFrame:
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "term")
    top = rated.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy(key).agg(
        normalise_keywords(F.transform(ordered, lambda t: t["term"]), n).alias("keywords")
    )


def fill_keywords(essays: DataFrame, n: int = MAX_KEYWORDS) -> DataFrame:
    """Write extracted keywords where any were found; other essays keep theirs."""
    text = F.concat_ws(" ", "question", "answer")
    found = extract_keywords(essays.select("id", text.alias("text")), n=n)
    return (
        essays.join(found.withColumnRenamed("keywords", "_found"), "id", "left")
        .withColumn("keywords", F.coalesce("_found", "keywords"))
        .select(*essays.columns)
    )
