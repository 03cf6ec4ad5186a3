"""Queries on postings, the store and their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims, digest, known, mapping, policy, relevance, skills, stored, summary
from ..operators.dedupe import dedupe_batch
from ..operators.embed import embed
from ..operators.latest import upsert_latest
from ..session import scratch_path, written
from ..schemas import RAW_JOB
from ..sources import cvs as cv_files
from ..sources import postings, tables
from . import bindings as b
from .bindings import NOW, with_views
from .registry import query
from .text_queries import CORPUS_CUES, SKILLS_SQL, corpus_dictionary, groups_text

RAW_FIELDS = RAW_JOB.names


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _ts_sql(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


# --- sources and sinks -----------------------------------------------------------------


@query(
    "read_jobs_json",
    with_views("jobs_flat")
    + """
SELECT arrival, job_id, title, url, description, company_name, category, industry, date_posted,
  valid_through, employment_type, currency, min_value, max_value, experience_months, region, is_remote,
  can_apply, source FROM jobs_flat""",
)
def read_jobs_json(spark: SparkSession, sf: str) -> DataFrame:
    payloads = b.jobs_raw(spark, sf).select(
        "arrival", F.to_json(F.struct(*RAW_FIELDS)).alias("payload")
    )
    return payloads.select("arrival", postings.parse_job("payload").alias("job")).select(
        "arrival",
        "job.job_id",
        "job.title",
        "job.url",
        "job.description",
        F.col("job.company.name").alias("company_name"),
        "job.category",
        "job.industry",
        "job.date_posted",
        "job.valid_through",
        "job.employment_type",
        "job.salary.currency",
        "job.salary.min_value",
        "job.salary.max_value",
        "job.experience_months",
        "job.location.region",
        "job.location.is_remote",
        "job.location.can_apply",
        "job.source",
    )


def envelopes(raw: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One response per group; jobs without a source come as an error.

    A batch is a fixed range of 100 arrivals, which bounds its array.
    """
    jobs = F.array_sort(F.collect_list(F.struct("arrival", *RAW_FIELDS)))
    return raw.groupBy(*by).agg(
        F.min("arrival").alias("sequence"),
        F.transform(jobs, lambda job: job.dropFields("arrival")).alias("jobs"),
        F.count("*").cast("int").alias("jobs_count"),
        F.lit(False).alias("is_complete"),
    )


@query(
    "explode_envelopes",
    with_views("jobs_flat")
    + """
SELECT source AS correlation_id, batch_no, job_id, url, CAST(NULL AS VARCHAR) AS error
FROM jobs_flat WHERE source IS NOT NULL
UNION ALL
SELECT DISTINCT 'other', batch_no, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'no source'
FROM jobs_flat WHERE source IS NULL""",
)
def explode_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Responses per batch and source; a batch without source reports an error."""
    ok = F.col("source").isNotNull()
    raw = b.jobs_raw(spark, sf, text=False)
    responses = envelopes(raw, ("batch_no", "source")).withColumns(
        {
            "correlation_id": F.coalesce("source", F.lit("other")),
            "success": ok,
            "error": F.when(~ok, "no source"),
        }
    )
    jobs, errors = postings.explode_envelopes(responses.drop("source"))
    return jobs.select("correlation_id", "batch_no", "job_id", "url").unionByName(
        errors.select("correlation_id", "batch_no", "error"), allowMissingColumns=True
    )


@query("read_cv_texts", "SELECT doc_id AS user_id, text || chr(10) AS text FROM documents")
def read_cv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Write every document as a user's text file, then read the files back."""
    path = scratch_path(spark, "cv-files")
    texts = b.documents(spark, sf).select(F.col("doc_id").alias("user_id"), "text")
    cv_files.write_cv_texts(texts, path)
    read = cv_files.read_cv_texts(spark, path, user_pattern=cv_files.USER_FILE)
    return read.where("error IS NULL").select("user_id", "text")


@query(
    "upsert_latest",
    """SELECT d.doc_id AS user_id, CASE WHEN l.doc_id IS NULL THEN d.text
  ELSE 'revised ' || d.text END AS text, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS revision
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
)
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """CVs, of which the labelled ones are uploaded again."""
    base = b.cvs(spark, sf, vectors=False).withColumn("revision", F.lit(0))
    labelled = b.table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"))
    again = base.join(labelled, "user_id", "left_semi").select(
        "user_id",
        F.concat(F.lit("revised "), "text").alias("text"),
        F.lit(1).alias("revision"),
    )
    return upsert_latest(base, again, "user_id", "revision")


@query(
    "store_snapshot",
    with_views("jobs_store")
    + """
SELECT external_id, title, url AS source_url, min_value AS salary_min, 1 AS version
FROM jobs_store""",
)
def store_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "job-store")
    rows = b.jobs_store(spark, sf).select("external_id", "title", "source_url", "salary_min")
    tables.store_snapshot(rows, path, 1)
    return tables.read_store(spark, path).withColumnRenamed(tables.VERSION, "version")


@query("read_store", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def read_store(spark: SparkSession, sf: str) -> DataFrame:
    """Documents committed in two versions, read back as one table."""
    path = scratch_path(spark, "documents")
    rows = b.documents(spark, sf).select("doc_id", "lang", "source", "n_chars", "text")
    later = F.col("doc_id") % 2 == 1
    tables.store_snapshot(rows.where(~later), path, 0, partition_by=["lang"])
    tables.store_snapshot(rows.where(later), path, 1, partition_by=["lang"])
    return tables.read_store(spark, path).select(*rows.columns)


# --- mapping and dimensions --------------------------------------------------------------


@query(
    "map_to_model",
    with_views("jobs_flat")
    + f"""
SELECT arrival, CAST(job_id AS VARCHAR) AS external_id, title, url AS source_url, source,
  employment_type AS job_type, CAST(trunc(experience_months) AS INTEGER) AS experience_months,
  nullif(company_name, '') AS company_name, nullif(region, '') AS location_region,
  nullif(category, '') AS category_name, nullif(industry, '') AS industry_name,
  coalesce(currency, 'USD') AS salary_currency, min_value AS salary_min, max_value AS salary_max,
  coalesce(is_remote, FALSE) AS is_remote, TRUE AS is_relevant, FALSE AS is_filtered,
  {_ts_sql("posted_at")}, {_ts_sql("expires_at")}, description
FROM jobs_flat""",
)
def map_to_model(spark: SparkSession, sf: str) -> DataFrame:
    flat = mapping.map_to_model(b.jobs_raw(spark, sf))
    drop = ("user_id", "batch_no", "must_have_skills", "nice_to_have_skills")
    return flat.drop(*drop).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("posted_at", "expires_at")}
    )


@query(
    "parse_iso_timestamps",
    with_views("jobs_flat")
    + f"""
SELECT arrival, {_ts_sql("posted_at")}, CAST(epoch(posted_at) AS BIGINT) AS posted_s,
  {_ts_sql("expires_at")} FROM jobs_flat""",
)
def parse_iso_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    texts = b.jobs_raw(spark, sf, text=False).select("arrival", "date_posted", "valid_through")
    parsed = mapping.parse_iso_timestamps(
        texts, {"posted_at": "date_posted", "expires_at": "valid_through"}
    )
    return parsed.select(
        "arrival",
        _ts("posted_at"),
        F.unix_timestamp("posted_at").alias("posted_s"),
        _ts("expires_at"),
    )


DIM_SQL = """dims AS (
  SELECT 'company_name' AS dimension, row_number() OVER (ORDER BY name) AS id, name
    FROM (SELECT DISTINCT company_name AS name FROM jobs_flat WHERE company_name <> '')
  UNION ALL SELECT 'location_region', row_number() OVER (ORDER BY name), name
    FROM (SELECT DISTINCT region AS name FROM jobs_flat WHERE region <> '')
  UNION ALL SELECT 'category_name', row_number() OVER (ORDER BY name), name
    FROM (SELECT DISTINCT category AS name FROM jobs_flat WHERE category <> '')
  UNION ALL SELECT 'industry_name', row_number() OVER (ORDER BY name), name
    FROM (SELECT DISTINCT industry AS name FROM jobs_flat WHERE industry <> ''))"""

DIM_JOINS = """
LEFT JOIN dims co ON co.dimension = 'company_name' AND co.name = j.company_name
LEFT JOIN dims lo ON lo.dimension = 'location_region' AND lo.name = j.region
LEFT JOIN dims ca ON ca.dimension = 'category_name' AND ca.name = j.category
LEFT JOIN dims ind ON ind.dimension = 'industry_name' AND ind.name = j.industry"""


def _dims(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return dims.build_dimensions(b.incoming(spark, sf))


@query(
    "build_dimension",
    with_views("jobs_flat") + f",\n{DIM_SQL}\nSELECT dimension, id, name FROM dims",
)
def build_dimension(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for key, dim in _dims(spark, sf).items():
        rows = dim.select(F.lit(key).alias("dimension"), "id", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "resolve_dimensions",
    with_views("jobs_flat")
    + f""",\n{DIM_SQL}
SELECT arrival, co.id AS company_id, lo.id AS location_id, ca.id AS category_id,
  ind.id AS industry_id, title FROM jobs_flat j {DIM_JOINS}""",
)
def resolve_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    flat = b.incoming(spark, sf)
    facts = dims.resolve_dimensions(flat, dims.build_dimensions(flat))
    return facts.select("arrival", *dims.DIMENSIONS.values(), "title")


@query(
    "json_field_backfill",
    """SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS INTEGER) AS k
FROM events""",
)
def json_field_backfill(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events").select("event_id", "props")
    return mapping.json_field_backfill(events, "props", "$.k", "k").drop("props")


@query(
    "add_flag_columns",
    with_views("jobs_store")
    + """
SELECT external_id, coalesce(is_remote, FALSE) AS is_remote, TRUE AS is_relevant,
  FALSE AS is_filtered FROM jobs_store""",
)
def add_flag_columns(spark: SparkSession, sf: str) -> DataFrame:
    store = b.jobs_store(spark, sf).select("external_id", "is_remote")
    return mapping.add_flag_columns(store)


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    names = _dims(spark, sf)
    return dims.resolve_dimensions(b.jobs_store(spark, sf), names), names


@query(
    "denormalise_jobs",
    with_views("jobs_store")
    + f""",\n{DIM_SQL}
SELECT external_id, title, co.id AS company_id, co.name AS company_name, lo.id AS location_id,
  lo.name AS location_region, ca.id AS category_id, ca.name AS category_name,
  ind.id AS industry_id, ind.name AS industry_name,
  strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') AS posted_at,
  strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') AS expires_at
FROM jobs_store j {DIM_JOINS}""",
)
def denormalise_jobs(spark: SparkSession, sf: str) -> DataFrame:
    facts, names = _facts(spark, sf)
    wide = dims.denormalise_jobs(facts, names)
    pairs = [c for pair in dims.DIMENSIONS.items() for c in pair]
    return wide.select("external_id", "title", *pairs, "posted_at", "expires_at")


@query(
    "rebuild_legacy_document",
    with_views("jobs_store")
    + f""",\n{DIM_SQL}
SELECT external_id, co.name AS company, lo.name AS location,
  CASE WHEN ca.id IS NOT NULL AND ind.id IS NOT NULL THEN ca.name END AS doc_category,
  CASE WHEN ca.id IS NOT NULL AND ind.id IS NOT NULL THEN ind.name END AS doc_industry,
  CASE WHEN ca.id IS NOT NULL AND ind.id IS NOT NULL THEN experience_months END AS doc_months
FROM jobs_store j {DIM_JOINS}""",
)
def rebuild_legacy_document(spark: SparkSession, sf: str) -> DataFrame:
    facts, names = _facts(spark, sf)
    old = dims.rebuild_legacy_document(facts, names)
    field = lambda name: F.get_json_object("extra_data", f"$.{name}")
    return old.select(
        "external_id",
        "company",
        "location",
        field("category").alias("doc_category"),
        field("industry").alias("doc_industry"),
        field("experience_months").cast("double").alias("doc_months"),
    )


# --- known jobs --------------------------------------------------------------------------

# Conflict of an earlier row with a later one, and unrolled rounds of "keep what no open
# earlier row blocks, drop what a kept row blocks".


def rounds_sql(source: str, n: int = 10, tag: str = "") -> str:
    """Edges and rounds over a relation with (arrival, external_id, url, source)."""
    parts = [
        f"""{tag}edges AS MATERIALIZED (
  SELECT a.arrival AS early, b.arrival AS late FROM {source} a JOIN {source} b
    ON a.external_id = b.external_id AND a.arrival < b.arrival
  UNION
  SELECT a.arrival, b.arrival FROM {source} a JOIN {source} b
    ON a.url = b.url AND a.arrival < b.arrival AND (b.source IS NULL OR a.source = b.source))""",
        f"{tag}open0 AS MATERIALIZED (SELECT arrival FROM {source})",
    ]
    for i in range(n):
        now, then, won = f"{tag}open{i}", f"{tag}open{i + 1}", f"{tag}kept{i}"
        parts.append(
            f"""{won} AS MATERIALIZED (SELECT arrival FROM {now} o WHERE NOT EXISTS (
  SELECT 1 FROM {tag}edges e JOIN {now} p ON p.arrival = e.early WHERE e.late = o.arrival)),
{then} AS MATERIALIZED (SELECT arrival FROM {now} WHERE arrival NOT IN (SELECT arrival FROM {won})
  AND arrival NOT IN (SELECT e.late FROM {tag}edges e JOIN {won} k ON k.arrival = e.early))"""
        )
    union = " UNION ALL ".join(f"SELECT arrival FROM {tag}kept{i}" for i in range(n))
    return ",\n".join(parts) + f",\n{tag}kept AS ({union})"


@query(
    "dedupe_batch",
    with_views("incoming")
    + f""",\n{rounds_sql("incoming")}
SELECT i.arrival, i.external_id, i.url AS source_url, k.arrival IS NOT NULL AS kept
FROM incoming i LEFT JOIN kept k ON k.arrival = i.arrival""",
)
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_batch(b.incoming(spark, sf)).select(
        "arrival", "external_id", "source_url", "kept"
    )


KNOWN_SQL = """known AS (
  SELECT i.arrival,
    EXISTS (SELECT 1 FROM jobs_store s WHERE s.external_id = i.external_id
      AND (i.source IS NULL OR s.source = i.source)) AS known_by_id,
    EXISTS (SELECT 1 FROM jobs_store s WHERE s.url = i.url
      AND (i.source IS NULL OR s.source = i.source)) AS known_by_url,
    EXISTS (SELECT 1 FROM jobs_store s WHERE s.external_id = i.external_id) AS id_anywhere,
    EXISTS (SELECT 1 FROM jobs_store s WHERE s.url = i.url) AS url_anywhere,
    EXISTS (SELECT 1 FROM jobs_store s WHERE s.title = i.title
      AND s.company_name = i.company_name
      AND (s.expires_at IS NULL OR s.expires_at >= TIMESTAMP '""" + NOW + """')) AS active
  FROM incoming i)"""


@query(
    "find_existing",
    with_views("incoming", "jobs_store")
    + f""",\n{KNOWN_SQL}
SELECT arrival, known_by_id, known_by_url, known_by_id OR known_by_url AS "exists" FROM known""",
)
def find_existing(spark: SparkSession, sf: str) -> DataFrame:
    flagged = known.find_existing(b.incoming(spark, sf), b.jobs_store(spark, sf))
    return flagged.select("arrival", "known_by_id", "known_by_url", "exists")


INSERT_SQL = f"""{KNOWN_SQL},
fresh AS (SELECT i.* FROM incoming i JOIN known k ON k.arrival = i.arrival
  WHERE NOT k.known_by_id AND NOT k.known_by_url AND NOT k.id_anywhere),
{rounds_sql("fresh")},
outcomes AS (
  SELECT i.arrival, CASE WHEN n.known_by_id OR n.known_by_url THEN 'duplicate'
    WHEN k.arrival IS NOT NULL THEN 'stored'
    WHEN EXISTS (SELECT 1 FROM fresh a JOIN kept ka ON ka.arrival = a.arrival
      WHERE a.arrival < i.arrival AND (a.external_id = i.external_id OR a.url = i.url)
      AND (i.source IS NULL OR a.source = i.source)) THEN 'duplicate'
    ELSE 'integrity_error' END AS outcome
  FROM incoming i JOIN known n ON n.arrival = i.arrival
  LEFT JOIN kept k ON k.arrival = i.arrival)"""


@query(
    "insert_new_jobs",
    with_views("incoming", "jobs_store")
    + f",\n{INSERT_SQL}\nSELECT arrival, outcome FROM outcomes",
)
def insert_new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    out = known.insert_new_jobs(b.incoming(spark, sf), b.jobs_store(spark, sf))
    return out.select("arrival", "outcome")


@query(
    "save_rejected",
    with_views("incoming", "jobs_store")
    + f""",\n{KNOWN_SQL},
fresh AS (SELECT i.* FROM incoming i JOIN known k ON k.arrival = i.arrival
  WHERE NOT k.id_anywhere AND NOT k.url_anywhere
  AND (coalesce(i.experience_months, 0) > 60 OR NOT coalesce(i.can_apply, FALSE))),
{rounds_sql("fresh")}
SELECT f.arrival, f.external_id, TRUE AS is_filtered, FALSE AS is_relevant
FROM fresh f JOIN kept k ON k.arrival = f.arrival""",
)
def save_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the default policy rejects."""
    jobs = b.incoming(spark, sf)
    rejected = jobs.where(~policy.passes(jobs, policy.default_policy()))
    return known.save_rejected(rejected, b.jobs_store(spark, sf)).select(
        "arrival", "external_id", "is_filtered", "is_relevant"
    )


@query(
    "active_title_company",
    with_views("incoming", "jobs_store") + f",\n{KNOWN_SQL}\nSELECT arrival, active FROM known",
)
def active_title_company(spark: SparkSession, sf: str) -> DataFrame:
    flagged = known.active_title_company(b.incoming(spark, sf), b.jobs_store(spark, sf), NOW)
    return flagged.select("arrival", "active")


# --- filters, aggregates, pages ------------------------------------------------------------


@query(
    "filter_policy",
    with_views("jobs_flat")
    + """
SELECT arrival, experience_months, region FROM jobs_flat
WHERE coalesce(experience_months, 0) <= 60 AND coalesce(can_apply, FALSE)""",
)
def filter_policy(spark: SparkSession, sf: str) -> DataFrame:
    kept = policy.filter_policy(b.jobs_raw(spark, sf, text=False))
    return kept.select("arrival", "experience_months", F.col("location.region").alias("region"))


@query(
    "is_existing_job",
    with_views("incoming", "jobs_store")
    + f",\n{KNOWN_SQL}\nSELECT arrival, known_by_id OR active AS existing FROM known",
)
def is_existing_job(spark: SparkSession, sf: str) -> DataFrame:
    jobs = b.jobs_raw(spark, sf, text=False)
    flagged = known.is_existing_job(jobs, b.jobs_store(spark, sf), NOW)
    return flagged.select("arrival", "existing")


TAGGED_SQL = f"""{KNOWN_SQL},
tagged AS (
  SELECT i.arrival, i.batch_no, i.title, CASE WHEN k.known_by_id OR k.active THEN 'existing'
    WHEN coalesce(i.experience_months, 0) <= 60 AND coalesce(i.can_apply, FALSE) THEN 'passed'
    ELSE 'rejected' END AS outcome
  FROM incoming i JOIN known k ON k.arrival = i.arrival)"""


def tagged_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = b.jobs_raw(spark, sf, text=False)
    return policy.split_passed_rejected(jobs, b.jobs_store(spark, sf), NOW)


@query(
    "split_passed_rejected",
    with_views("incoming", "jobs_store")
    + f",\n{TAGGED_SQL}\nSELECT arrival, title, outcome FROM tagged",
)
def split_passed_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return tagged_jobs(spark, sf).select("arrival", "title", "outcome")


@query(
    "scrape_predicates",
    with_views("incoming", "jobs_store")
    + f"""
SELECT i.arrival, i.url AS source_url, i.min_value AS salary_min FROM incoming i
WHERE i.min_value >= 4000 AND i.is_remote AND i.posted_at >= TIMESTAMP '1999-06-01 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM jobs_store s WHERE s.url = i.url AND s.source = 'src_b'
    AND s.posted_at >= TIMESTAMP '{NOW}' - INTERVAL 60 DAYS)""",
)
def scrape_predicates(spark: SparkSession, sf: str) -> DataFrame:
    urls = stored.existing_urls(b.jobs_store(spark, sf), "src_b", 60, NOW)
    kept = policy.scrape_predicates(
        b.incoming(spark, sf), urls, posted_after="1999-06-01 00:00:00"
    )
    return kept.select("arrival", "source_url", "salary_min")


@query(
    "existing_urls",
    with_views("jobs_store")
    + f"""
SELECT 'all' AS look_back, url AS source_url FROM jobs_store
  WHERE source = 'src_a' AND url IS NOT NULL
UNION ALL SELECT '60 days', url FROM jobs_store
  WHERE source = 'src_a' AND url IS NOT NULL
    AND posted_at >= TIMESTAMP '{NOW}' - INTERVAL 60 DAYS""",
)
def existing_urls(spark: SparkSession, sf: str) -> DataFrame:
    store = b.jobs_store(spark, sf)
    every = stored.existing_urls(store, "src_a", None, NOW)
    recent = stored.existing_urls(store, "src_a", 60, NOW)
    return every.select(F.lit("all").alias("look_back"), "source_url").unionByName(
        recent.select(F.lit("60 days").alias("look_back"), "source_url")
    )


@query(
    "lookup_external_id",
    with_views("incoming", "jobs_store")
    + """
SELECT s.external_id, s.title, s.source FROM jobs_store s WHERE EXISTS (SELECT 1 FROM incoming i
  WHERE i.external_id = s.external_id AND (i.source IS NULL OR i.source = s.source)
  AND i.posted_at >= TIMESTAMP '1999-01-01 00:00:00')""",
)
def lookup_external_id(spark: SparkSession, sf: str) -> DataFrame:
    """Keys: the id and source of postings since 1999."""
    jobs = b.incoming(spark, sf)
    since = known.utc("1999-01-01 00:00:00", "posted_at", jobs)
    keys = jobs.where(F.col("posted_at") >= since).select("external_id", "source")
    found = stored.lookup_external_id(b.jobs_store(spark, sf), keys)
    return found.select("external_id", "title", "source")


@query(
    "latest_updated",
    with_views("jobs_store")
    + "\nSELECT "
    + _ts_sql("max(updated_at)", "latest_updated_at")
    + " FROM jobs_store",
)
def latest_updated(spark: SparkSession, sf: str) -> DataFrame:
    return stored.latest_updated(b.jobs_store(spark, sf)).select(_ts("latest_updated_at"))


@query(
    "posted_after_cutoff",
    with_views("jobs_store")
    + f"""
SELECT 'auto' AS kind, {_ts_sql(f"greatest(coalesce(max(updated_at), TIMESTAMP '{NOW}' - INTERVAL 5 DAYS), TIMESTAMP '{NOW}' - INTERVAL 5 DAYS)", "posted_after")} FROM jobs_store
UNION ALL SELECT 'mid-1999', {_ts_sql("greatest(max(updated_at), TIMESTAMP '1999-12-28 00:00:00')", "posted_after")} FROM jobs_store
UNION ALL SELECT '10 days', {_ts_sql(f"TIMESTAMP '{NOW}' - INTERVAL 10 DAYS", "posted_after")}""",
)
def posted_after_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    store = b.jobs_store(spark, sf)
    kinds = {
        "auto": stored.posted_after_cutoff(store, None, NOW),
        "mid-1999": stored.posted_after_cutoff(store, None, "2000-01-02 00:00:00"),
        "10 days": stored.posted_after_cutoff(store, 10, NOW),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(F.lit(kind).alias("kind"), _ts("posted_after"))
        out = rows if out is None else out.unionByName(rows)
    return out


SUMMARY_COLUMNS = """count(*) AS total_scraped,
  count(*) FILTER (outcome = 'passed') AS total_filtered,
  count(*) FILTER (outcome = 'passed') AS total_processed,
  count(*) FILTER (outcome = 'rejected') AS rejected,
  count(*) FILTER (outcome = 'existing') AS already_known,
  count(*) FILTER (outcome = 'passed' AND is_relevant) AS relevant"""


# --- documents about jobs -----------------------------------------------------------------

FORMATTED_SQL = "category || ' or ' || industry || ', ' || employment_type"


@query(
    "job_digest",
    with_views("jobs_flat")
    + """,
relevant AS (SELECT *, row_number() OVER (ORDER BY arrival) AS k, count(*) OVER () AS n
  FROM jobs_flat WHERE can_apply)
SELECT arrival, k AS job_number, '📋 Job ' || k || '/' || n || chr(10) || chr(10)
  || '🏢 ' || title || chr(10)
  || '🏭 Company: ' || coalesce(company_name, 'N/A') || chr(10)
  || '💰 Salary: ' || coalesce(currency, '') || ' ' || CAST(min_value AS VARCHAR)
  || coalesce(' - ' || CAST(max_value AS VARCHAR), '') || chr(10)
  || '📍 Location: ' || region || CASE WHEN is_remote THEN ' (Remote)' ELSE '' END || chr(10)
  || '⏰ Type: ' || employment_type || chr(10)
  || chr(10) || '🔧 Must-have skills: ' || """
    + FORMATTED_SQL
    + """ || chr(10)
  || chr(10) || '🔗 URL: ' || url AS message
FROM relevant""",
)
def job_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs one may apply for; their category, industry and type stand in for skills."""
    jobs = b.incoming(spark, sf).withColumns(
        {
            "is_relevant": F.col("can_apply"),
            "must_have_skills": F.array(
                F.array("category_name", "industry_name"), F.array("job_type")
            ),
            "nice_to_have_skills": F.lit(None).cast("array<array<string>>"),
        }
    )
    return digest.job_digest(jobs)


# --- relevance ----------------------------------------------------------------------------

RELEVANCE_SQL = """compared AS (
  SELECT j.arrival, CASE WHEN nullif(c.text, '') IS NOT NULL AND nullif(j.description, '') IS NOT NULL
      AND j.embedding IS NOT NULL AND c.embedding IS NOT NULL
    THEN list_cosine_similarity(CAST(j.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))
    END AS similarity
  FROM jobs_flat j LEFT JOIN cvs c ON c.user_id = j.user_id),
scored AS (SELECT arrival, similarity, coalesce(similarity >= CAST(0.4 AS DOUBLE), TRUE)
  AS is_relevant FROM compared)"""


def scored_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.cosine_relevance(
        b.incoming(spark, sf, text=True, vectors=True), b.cvs(spark, sf)
    )


@query(
    "cosine_relevance",
    with_views("jobs_flat", "cvs")
    + f",\n{RELEVANCE_SQL}\n"
    + "SELECT arrival, round(similarity, 9) AS similarity, is_relevant FROM scored",
)
def cosine_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return scored_jobs(spark, sf).select(
        "arrival", F.round("similarity", 9).alias("similarity"), "is_relevant"
    )


JUDGED_SQL = """judged AS (SELECT t.arrival, t.batch_no, t.outcome, s.is_relevant
  FROM tagged t JOIN scored s ON s.arrival = t.arrival)"""


def judged_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting with its batch, outcome and relevance."""
    tagged = tagged_jobs(spark, sf).select("arrival", "batch_no", "outcome")
    return tagged.join(scored_jobs(spark, sf).select("arrival", "is_relevant"), "arrival")


@query(
    "run_summary",
    with_views("incoming", "jobs_store", "cvs")
    + f""",\n{TAGGED_SQL},\n{RELEVANCE_SQL},\n{JUDGED_SQL}
SELECT CAST(NULL AS BIGINT) AS batch_no, {SUMMARY_COLUMNS} FROM judged
UNION ALL SELECT batch_no, {SUMMARY_COLUMNS} FROM judged GROUP BY batch_no""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the run and of each batch."""
    judged = written(judged_jobs(spark, sf), "judged")
    overall = summary.run_summary(judged).withColumn("batch_no", F.lit(None).cast("bigint"))
    return overall.unionByName(summary.run_summary(judged, ["batch_no"]))


@query(
    "route_and_store",
    with_views("incoming", "jobs_store", "cvs")
    + f""",\n{RELEVANCE_SQL},\n{INSERT_SQL},
found AS ({SKILLS_SQL})
SELECT o.arrival, s.is_relevant, CASE WHEN s.is_relevant THEN
    CASE WHEN coalesce(f.must, '') = '' THEN 0 ELSE len(string_split(f.must, ';')) END END AS n_must,
  CASE WHEN s.is_relevant THEN coalesce(f.nice, '') END AS nice, o.outcome,
  CASE WHEN o.outcome = 'stored' THEN 'in_progress' ELSE 'error' END AS store_status,
  'completed' AS status
FROM outcomes o JOIN scored s ON s.arrival = o.arrival LEFT JOIN found f ON f.doc_id = o.arrival""",
)
def route_and_store(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant postings with the skills their descriptions name, inserted row by row."""
    scored = written(scored_jobs(spark, sf).drop("embedding"), "scored")
    wanted = scored.where("is_relevant AND description IS NOT NULL").select("arrival", "description")
    found = skills.extract_skills(wanted, corpus_dictionary(spark, sf), CORPUS_CUES)
    done = relevance.route_and_store(scored.drop("description"), b.jobs_store(spark, sf), found)
    return done.select(
        "arrival",
        "is_relevant",
        F.when(F.col("must_have_skills").isNotNull(), F.size("must_have_skills")).alias("n_must"),
        groups_text("nice_to_have_skills").alias("nice"),
        "outcome",
        "store_status",
        "status",
    )


@query("embed")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed term vectors of every document: width, length and first bucket."""
    docs = b.documents(spark, sf).select("doc_id", "text")
    return embed(docs, "text", 64).select(
        "doc_id",
        F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("string")), " ").alias(
            "embedding"
        ),
    )
