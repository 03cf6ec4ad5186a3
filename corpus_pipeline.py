"""From raw documents to packed training sequences, one written table per stage.

Each stage reads the whole table its predecessor kept. All but the last return the columns of ``documents``:

1. ``language``: documents without a letter, whose best language is less likely than not, or whose n-grams
   are less likely in it than those of its training documents, go;
2. ``quality``: documents scored below 0.5 by the classifier, fitted on the labels of folds 0 and 2, go;
3. ``linededup``: runs of lines that occurred before go, to both of their ends; ``n_chars`` follows the text, and a document of which
   nothing is left goes;
4. ``simhash``: of every group of documents whose fingerprints of three-word shingles are linked within 3 bits
   one stays, that of the smallest id;
5. ``packing``: one row per piece of the packed sequences.

Empty tables pass through; null texts go in the first stage; extra columns of the documents are kept
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm import langid, linededup, packing, quality, simhash
from vacanta.llm.common import fold, table, written
from vacanta.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(fold() != 1))
    return langid.in_known_language(docs, model, fold() != 1)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold() != 1)
    weights = quality.train(docs, labels)
    return quality.score(docs, weights).where("quality_score >= 0.5").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.remove_runs(docs)
    changed = F.col("lines_removed") > 0
    new = {
        "text": F.col("kept_text"),
        "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("bigint"),
    }
    return found.where(~changed | (F.length("kept_text") > 0)).select(
        *[new[c].alias(c) if c in new else F.col(c) for c in docs.columns]
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("linededup", without_repeated_lines),
    ("simhash", one_of_each),
    ("packing", packed),
]

#: Models, hashes and the tokenizer have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
