"""The driver tables seen as job postings, a job store, essays, CVs and queries.

Every binding uses its tables whole. Orders are postings: about one in twenty repeats the URL
of the posting before it and one in thirty-three its id, which gives in-batch clashes. The
store is what was posted before 2000 under its own id; the incoming batch is a full
re-scrape, so it holds the stored postings as well as new ones.

The SQL forms are common table expressions with the same meaning for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

#: The run's clock; the store ends just before.
NOW = "2000-01-15 00:00:00"
STORE_END = "2000-01-01 00:00:00"
JOBS_PER_USER = 15
JOBS_PER_BATCH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_flat(
    spark: SparkSession, sf_dir: str, text: bool = False, vectors: bool = False
) -> DataFrame:
    """One row per order. Ask for ``text`` and ``vectors`` only where they are used."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    jobs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("o_orderkey")
    columns = [
        (key - F.when(key % 33 == 0, 1).otherwise(0)).alias("job_id"),
        key.alias("arrival"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.concat(
            F.lit("https://jobs.example/"),
            (key - F.when(key % 20 == 0, 1).otherwise(0)).cast("string"),
        ).alias("url"),
        F.when(F.col("o_custkey") % 97 != 0, F.col("c_name")).alias("company_name"),
        F.col("o_orderpriority").alias("category"),
        F.col("c_mktsegment").alias("industry"),
        _iso(F.col("o_orderdate")).alias("date_posted"),
        _iso(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("valid_through"),
        F.when(key % 2 == 0, "FULL_TIME").otherwise("CONTRACT").alias("employment_type"),
        F.when(key % 7 != 0, "USD").alias("currency"),
        F.col("o_totalprice").alias("min_value"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 1.25).alias("max_value"),
        F.when(
            F.col("o_custkey") % 11 != 0, (F.col("o_custkey") % 120).cast("double") + 0.5
        ).alias("experience_months"),
        F.col("n_name").alias("region"),
        (F.col("n_nationkey") % 2 == 0).alias("is_remote"),
        (F.col("n_nationkey") % 3 != 0).alias("can_apply"),
        F.when(F.col("o_orderstatus") == "F", "src_a")
        .when(F.col("o_orderstatus") == "O", "src_b")
        .alias("source"),
        F.col("o_orderdate").alias("posted_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.floor(key / F.lit(JOBS_PER_USER)).alias("user_id"),
        F.floor(key / F.lit(JOBS_PER_BATCH)).alias("batch_no"),
    ]
    if text:
        texts = documents(spark, sf_dir).select("doc_id", "text")
        jobs = jobs.join(texts, key == F.col("doc_id"), "left")
        columns.append(F.col("text").alias("description"))
    if vectors:
        embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        jobs = jobs.join(embeddings, key == F.col("vec_id"), "left")
        columns.append(F.col("embedding"))
    return jobs.select(*columns)


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def jobs_raw(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """The incoming batch in the nested posting shape, with arrival, user and batch."""
    flat = jobs_flat(spark, sf_dir, text=text)
    description = F.col("description") if text else F.lit(None).cast("string")
    no_skills = F.lit(None).cast("array<array<string>>")
    return flat.select(
        "arrival",
        "user_id",
        "batch_no",
        "job_id",
        "title",
        "url",
        description.alias("description"),
        "source",
        F.struct(
            F.col("company_name").alias("name"), F.lit(None).cast("string").alias("website")
        ).alias("company"),
        "category",
        "industry",
        "date_posted",
        "valid_through",
        "employment_type",
        F.struct("currency", "min_value", "max_value").alias("salary"),
        "experience_months",
        F.struct("region", "is_remote", "can_apply").alias("location"),
        no_skills.alias("must_have_skills"),
        no_skills.alias("nice_to_have_skills"),
        F.lit(None).cast("boolean").alias("is_relevant"),
        F.lit(None).cast("boolean").alias("is_filtered"),
    )


def incoming(
    spark: SparkSession, sf_dir: str, text: bool = False, vectors: bool = False
) -> DataFrame:
    """The incoming batch, flat, under the names of the store."""
    return _stored_names(jobs_flat(spark, sf_dir, text, vectors))


def jobs_store(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Stored postings; external ids are unique."""
    flat = jobs_flat(spark, sf_dir, text)
    posted = F.lit(STORE_END).cast(flat.schema["posted_at"].dataType)
    stored = flat.where((F.col("posted_at") < posted) & (F.col("job_id") == F.col("arrival")))
    return _stored_names(stored).withColumns(
        {"created_at": F.col("posted_at"), "updated_at": F.col("posted_at")}
    )


def _stored_names(flat: DataFrame) -> DataFrame:
    return flat.withColumn("external_id", F.col("job_id").cast("string")).withColumnsRenamed(
        {
            "url": "source_url",
            "employment_type": "job_type",
            "currency": "salary_currency",
            "min_value": "salary_min",
            "max_value": "salary_max",
            "region": "location_region",
            "category": "category_name",
            "industry": "industry_name",
        }
    ).drop("job_id", "date_posted", "valid_through")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def qa_pairs(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Essays: a user turn and the assistant turn that answers it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pairs = asked.join(replies, ["conv_id", "turn"]).withColumn(
        "id", F.col("conv_id") * 1000 + F.col("turn")
    )
    if vectors:
        embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        at = (F.col("conv_id") * 7 + F.col("turn")) % 700
        pairs = pairs.join(embeddings, at == F.col("vec_id"), "left")
    else:
        pairs = pairs.withColumn("embedding", F.lit(None).cast("array<float>"))
    created = F.timestamp_seconds("id")
    return pairs.select(
        "id",
        "question",
        "answer",
        F.lit(None).cast("array<string>").alias("keywords"),
        "embedding",
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vector queries: the benchmark passages."""
    passages = table(spark, sf_dir, "benchmark")
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return passages.join(embeddings, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), "text", "embedding"
    )


def cvs(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """One CV per user: the documents."""
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("user_id"), "text")
    if not vectors:
        return texts
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return texts.join(embeddings, F.col("user_id") == F.col("vec_id"), "left").drop("vec_id")


# ---------------------------------------------------------------------------------------
# SQL forms for the oracles

_JOBS_FLAT = f"""jobs_flat AS (
  SELECT o.o_orderkey - CASE WHEN o.o_orderkey % 33 = 0 THEN 1 ELSE 0 END AS job_id,
    o.o_orderkey AS arrival,
    o.o_orderpriority || ' ' || c.c_mktsegment AS title,
    'https://jobs.example/'
      || CAST(o.o_orderkey - CASE WHEN o.o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS url,
    d.text AS description,
    CASE WHEN o.o_custkey % 97 = 0 THEN NULL ELSE c.c_name END AS company_name,
    o.o_orderpriority AS category, c.c_mktsegment AS industry,
    strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_posted,
    strftime(o.o_orderdate + INTERVAL 30 DAYS, '%Y-%m-%dT%H:%M:%SZ') AS valid_through,
    CASE WHEN o.o_orderkey % 2 = 0 THEN 'FULL_TIME' ELSE 'CONTRACT' END AS employment_type,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE 'USD' END AS currency,
    o.o_totalprice AS min_value,
    CASE WHEN o.o_orderstatus = 'P' THEN NULL
      ELSE o.o_totalprice * CAST(1.25 AS DOUBLE) END AS max_value,
    CASE WHEN o.o_custkey % 11 = 0 THEN NULL
      ELSE CAST(o.o_custkey % 120 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS experience_months,
    n.n_name AS region, (n.n_nationkey % 2 = 0) AS is_remote, (n.n_nationkey % 3 <> 0) AS can_apply,
    CASE o.o_orderstatus WHEN 'F' THEN 'src_a' WHEN 'O' THEN 'src_b' ELSE NULL END AS source,
    o.o_orderdate AS posted_at, o.o_orderdate + INTERVAL 30 DAYS AS expires_at,
    o.o_orderkey // {JOBS_PER_USER} AS user_id, o.o_orderkey // {JOBS_PER_BATCH} AS batch_no,
    e.embedding AS embedding
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey
  LEFT JOIN embeddings e ON e.vec_id = o.o_orderkey)"""

_JOBS_STORE = f"""jobs_store AS (
  SELECT *, CAST(job_id AS VARCHAR) AS external_id, posted_at AS updated_at FROM jobs_flat
  WHERE posted_at < TIMESTAMP '{STORE_END}' AND job_id = arrival)"""

_INCOMING = """incoming AS (
  SELECT *, CAST(job_id AS VARCHAR) AS external_id FROM jobs_flat)"""

_QA_PAIRS = """qa_pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS id, a.text AS question, b.text AS answer,
    e.embedding AS embedding
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  LEFT JOIN embeddings e ON e.vec_id = (a.conv_id * 7 + a.turn) % 700
  WHERE a.role = 'user' AND b.role = 'assistant')"""

_QUERIES = """queries AS (
  SELECT b.item_id AS query_id, b.text AS text, e.embedding AS embedding
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""

_CVS = """cvs AS (
  SELECT d.doc_id AS user_id, d.text AS text, e.embedding AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

_CTES = {
    "jobs_flat": _JOBS_FLAT,
    "jobs_store": _JOBS_STORE,
    "incoming": _INCOMING,
    "qa_pairs": _QA_PAIRS,
    "queries": _QUERIES,
    "cvs": _CVS,
}


def with_views(*names: str) -> str:
    """``WITH`` text for the named bindings and those they need, in order."""
    wanted = set(names)
    if wanted & {"jobs_store", "incoming"}:
        wanted.add("jobs_flat")
    return "WITH " + ",\n".join(sql for name, sql in _CTES.items() if name in wanted)
