"""The registered queries of this subpackage: operators applied to whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, covertree, langid, licences, linededup, maintext, packing, pieces, quality, rangejoin, rules, simhash
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold() != 1)
    weights = quality.train(docs, labels)
    return quality.score(docs.select("doc_id", "text"), weights).select(
        "doc_id",
        (fold() == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold() != 1))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold() == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


@query
def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.remove_repeated(docs).select("doc_id", "kept_text", "lines_removed")


ORACLES["op8_linededup"] = linededup.ORACLE


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_rangejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op5_rangejoin"] = rangejoin.ORACLE


@query
def op3_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op3_covertree"] = covertree.ORACLE


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.checked(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


@query
def op7_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_repeated"
    )


# The documents have no paths: a tree of sources, thousands and tens of ids stands in for one, in which the
# first document of each ten is the licence file of its directory.
_FILE = "CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE concat(CAST(doc_id AS STRING), '.txt') END"
_FILES = f"""
SELECT doc_id, concat_ws('/', source, CAST(floor(doc_id / 1000) AS INT), CAST(floor(doc_id / 10) AS INT), {_FILE}) AS path,
       text FROM documents"""


@query
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = _FILES.split("SELECT doc_id, ")[1].split(" AS path")[0]
    return licences.scan(docs.withColumn("path", F.expr(path)), keep=["doc_id"])


ORACLES["op10_licences"] = licences.oracle(_FILES, "doc_id")


@query
def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = rules.applied(rules.ledger(docs), rules.STANDARD)
    return rules.applied(rows, rules.BASE, "base_passed").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_passed")).alias("base_failed"), "kept", "failed",
    )


ORACLES["op12_rules"] = rules.ORACLE


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = collocations.ORACLE


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokens(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
