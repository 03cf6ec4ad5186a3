"""Queries on essays, skills, keywords and CV text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import tokens
from ..operators import essays, keywords, paging, prose, skills
from ..session import written
from . import bindings as b
from . import sql_text as sql
from .bindings import NOW, with_views
from .registry import query

WORDS_SQL = sql.tokens("text")
LINE_GROUPS_SQL = (
    "list_transform(string_split(text, chr(10)), lambda line: " + sql.tokens("line") + ")"
)


def _line_groups(c: str):
    """Skill groups of a text: a line is a group, its words are the alternatives."""
    return F.transform(F.split(c, "\n"), tokens)


# --- arrays -------------------------------------------------------------------------------


@query(
    "skills_1d_to_2d",
    f"""SELECT doc_id, CASE WHEN len({WORDS_SQL}) > 0
  THEN CAST(to_json(list_transform({WORDS_SQL}, lambda w: [w])) AS VARCHAR) END AS skills
FROM documents""",
)
def skills_1d_to_2d(spark: SparkSession, sf: str) -> DataFrame:
    flat = b.documents(spark, sf).select("doc_id", tokens("text").alias("words"))
    return flat.select("doc_id", F.to_json(arrays.skills_1d_to_2d("words")).alias("skills"))


@query(
    "skills_2d_to_1d",
    f"""SELECT doc_id, nullif(array_to_string(flatten({LINE_GROUPS_SQL}), ' '), '') AS skills
FROM documents""",
)
def skills_2d_to_1d(spark: SparkSession, sf: str) -> DataFrame:
    groups = b.documents(spark, sf).select("doc_id", _line_groups("text").alias("groups"))
    return groups.select(
        "doc_id", F.array_join(arrays.skills_2d_to_1d("groups"), " ").alias("skills")
    )


@query(
    "format_skills",
    f"""WITH g AS (SELECT doc_id, {LINE_GROUPS_SQL} AS groups FROM documents),
flat AS (SELECT doc_id, gi, unnest(grp) AS skill, generate_subscripts(grp, 1) AS si FROM (
  SELECT doc_id, unnest(groups) AS grp, generate_subscripts(groups, 1) AS gi FROM g)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gi, si) AS k,
  count(*) OVER (PARTITION BY doc_id) AS n FROM flat),
per_group AS (SELECT doc_id, gi, any_value(n) AS n, string_agg(skill, ' or ' ORDER BY si) AS part
  FROM numbered WHERE k <= 10 GROUP BY doc_id, gi),
shown AS (SELECT doc_id, string_agg(part, ', ' ORDER BY gi)
  || CASE WHEN any_value(n) > 10 THEN ' ... and ' || (any_value(n) - 10) || ' more' ELSE '' END
  AS skills FROM per_group GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.skills, '') AS skills
FROM documents d LEFT JOIN shown s ON s.doc_id = d.doc_id""",
)
def format_skills(spark: SparkSession, sf: str) -> DataFrame:
    groups = b.documents(spark, sf).select("doc_id", _line_groups("text").alias("groups"))
    return groups.select("doc_id", arrays.format_skills("groups").alias("skills"))


@query(
    "skill_match",
    with_views("jobs_flat", "cvs")
    + f""",
need AS (SELECT j.arrival, {LINE_GROUPS_SQL.replace("text", "j.description")} AS groups,
    {sql.tokens("c.text")} AS candidate
  FROM jobs_flat j LEFT JOIN cvs c ON c.user_id = j.user_id)
SELECT arrival, coalesce(len(list_filter(groups, lambda g: list_has_any(g, candidate))), 0)
    AS matched, coalesce(len(groups), 0) AS total,
  coalesce(len(list_filter(groups, lambda g: list_has_any(g, candidate))), 0)
    = coalesce(len(groups), 0) AS all_matched
FROM need""",
)
def skill_match(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a description as AND groups, against the words of the user's CV."""
    jobs = b.incoming(spark, sf, text=True).select(
        "arrival", "user_id", _line_groups("description").alias("groups")
    )
    candidates = b.cvs(spark, sf, vectors=False).select(
        "user_id", F.array_distinct(tokens("text")).alias("candidate")
    )
    joined = jobs.join(candidates, "user_id", "left")
    return skills.skill_match(joined, "groups", "candidate").select(
        "arrival", "matched", "total", "all_matched"
    )


RAW_WORDS_SQL = "string_split(text, ' ')"


@query(
    "normalise_keywords",
    f"""WITH raw AS (SELECT doc_id, {sql.trim("w")} AS word, i FROM (
  SELECT doc_id, unnest({RAW_WORDS_SQL}) AS w, generate_subscripts({RAW_WORDS_SQL}, 1) AS i
  FROM documents)),
firsts AS (SELECT doc_id, word, i, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY i)
  AS copy FROM raw WHERE word <> ''),
ranked AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM firsts WHERE copy = 1)
SELECT d.doc_id, coalesce(r.keywords, '') AS keywords FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(word, '|' ORDER BY k) AS keywords FROM ranked WHERE k <= 10
  GROUP BY doc_id) r ON r.doc_id = d.doc_id""",
)
def normalise_keywords(spark: SparkSession, sf: str) -> DataFrame:
    raw = b.documents(spark, sf).select("doc_id", F.split("text", " ").alias("raw"))
    return raw.select(
        "doc_id", F.array_join(arrays.normalise_keywords("raw"), "|").alias("keywords")
    )


# --- essays -------------------------------------------------------------------------------


@query(
    "parse_qa_text",
    with_views("qa_pairs")
    + f""",
texts AS (SELECT 'essay' AS kind, id, 'Question: ' || question || chr(10) || 'ANSWER: ' || answer
    AS text FROM qa_pairs
  UNION ALL SELECT 'answer', id, 'answer:' || answer FROM qa_pairs
  UNION ALL SELECT 'nested', id, 'Question: ' || chr(10) || 'Answer: ' || question || ' answer: '
    FROM qa_pairs
  UNION ALL SELECT 'document', doc_id, text FROM documents),
parts AS (SELECT *, regexp_matches(text, '(?is)^(.*)answer:(.*)$') AS marked,
    regexp_extract(text, '(?is)^(.*)answer:(.*)$', 1) AS before,
    regexp_extract(text, '(?is)^(.*)answer:(.*)$', 2) AS after FROM texts),
parsed AS (SELECT kind, id, CASE WHEN marked THEN nullif({sql.trim(
        "regexp_extract(before, '(?is)^.*?question:(.*)$', 1)")}, '') END AS question,
    CASE WHEN marked THEN {sql.trim("after")} END AS answer FROM parts)
SELECT kind, id, question, answer, coalesce(answer <> '', FALSE) AS valid FROM parsed""",
)
def parse_qa_text(spark: SparkSession, sf: str) -> DataFrame:
    pairs = b.qa_pairs(spark, sf)

    def rows(kind: str, *text) -> DataFrame:
        return pairs.select(F.lit(kind).alias("kind"), "id", F.concat(*text).alias("text"))

    texts = (
        rows("essay", F.lit("Question: "), "question", F.lit("\nANSWER: "), "answer")
        .unionByName(rows("answer", F.lit("answer:"), "answer"))
        .unionByName(rows("nested", F.lit("Question: \nAnswer: "), "question", F.lit(" answer: ")))
        .unionByName(
            b.documents(spark, sf).select(
                F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
            )
        )
    )
    return essays.parse_qa_text(texts, "text").drop("text")


@query(
    "essay_create_update",
    with_views("qa_pairs")
    + """,
created AS (SELECT id, question, answer, CAST(NULL AS VARCHAR) AS keywords, id AS updated FROM qa_pairs
  UNION ALL SELECT (SELECT max(id) FROM qa_pairs) + row_number() OVER (ORDER BY item_id),
    CAST(NULL AS VARCHAR), text, 'passage', epoch(TIMESTAMP '2000-01-15 00:00:00') FROM benchmark),
updates AS (SELECT id, length(question) > length(answer) AS long_question FROM qa_pairs)
SELECT c.id,
  CASE WHEN u.long_question THEN NULL ELSE c.question END AS question,
  c.answer,
  CASE WHEN u.long_question IS NOT NULL AND NOT u.long_question THEN 'short|asked'
    ELSE c.keywords END AS keywords,
  CAST(CASE WHEN u.id IS NOT NULL THEN epoch(TIMESTAMP '2000-01-15 00:00:00') ELSE c.updated END
    AS BIGINT) AS updated_s
FROM created c LEFT JOIN updates u ON u.id = c.id AND u.id > 0
WHERE c.id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id > 0)""",
)
def essay_create_update(spark: SparkSession, sf: str) -> DataFrame:
    """Passages become answers; a long question is dropped, other essays get keywords."""
    stored = b.qa_pairs(spark, sf)
    creates = b.table(spark, sf, "benchmark").select(
        "item_id",
        F.lit(None).cast("string").alias("question"),
        F.col("text").alias("answer"),
        F.array(F.lit("passage")).alias("keywords"),
    )
    long_question = F.length("question") > F.length("answer")
    updates = stored.select(
        "id",
        F.lit(None).cast("string").alias("question"),
        F.lit(None).cast("string").alias("answer"),
        F.array(F.lit("short"), F.lit("asked")).alias("keywords"),
        F.when(long_question, F.array(F.lit("question")))
        .otherwise(F.array(F.lit("keywords")))
        .alias("supplied"),
    )
    deletes = b.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return essays.essay_create_update(
        stored, creates, updates, deletes, NOW, order="item_id"
    ).select(
        "id",
        "question",
        "answer",
        F.array_join("keywords", "|").alias("keywords"),
        F.unix_timestamp("updated_at").alias("updated_s"),
    )


@query(
    "result_preview",
    f"""SELECT doc_id, '**Answer:** ' || CASE WHEN length(text) > 500
    THEN substring(text, 1, 500) || '...' ELSE text END || chr(10) || '**Keywords:** '
    || CASE WHEN len({WORDS_SQL}) > 0 THEN array_to_string({WORDS_SQL}, ', ') ELSE 'No keywords' END
    AS search_preview,
  doc_id || '. A: ' || CASE WHEN length(text) > 100
    THEN substring(text, 1, 100) || '...' ELSE text END
    || CASE WHEN len({WORDS_SQL}) > 0
    THEN chr(10) || 'Keywords: ' || array_to_string({WORDS_SQL}, ', ') ELSE '' END AS list_preview
FROM documents""",
)
def result_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answers without a question, their words as keywords."""
    rows = b.documents(spark, sf).select(
        "doc_id",
        F.lit(None).cast("string").alias("question"),
        F.col("text").alias("answer"),
        tokens("text").alias("keywords"),
    )
    return essays.result_preview(rows, "doc_id").select(
        "doc_id", "search_preview", "list_preview"
    )


def _page_sql(asked: int, page: int) -> str:
    return f"""SELECT * FROM (SELECT {asked} AS asked, id, question,
    (SELECT count(*) FROM qa_pairs) AS total_count,
    greatest(CAST(ceil((SELECT count(*) FROM qa_pairs) / 5.0) AS BIGINT), 1) AS total_pages
  FROM qa_pairs ORDER BY id DESC LIMIT 5 OFFSET {(page - 1) * 5})"""


@query(
    "paginate",
    with_views("qa_pairs")
    + "\n"
    + "\nUNION ALL ".join([_page_sql(0, 1), _page_sql(3, 3), _page_sql(100000, 100000)]),
)
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    """Page 0 (the first), page 3, and a page past the end."""
    rows = b.qa_pairs(spark, sf).select("id", "question", "created_at")
    out = None
    for page in (0, 3, 100000):
        part = paging.paginate(rows, page, 5).drop("created_at").withColumn("asked", F.lit(page))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "embedding_text",
    with_views("qa_pairs")
    + f"""
SELECT id, concat_ws(' ', nullif(question, ''), nullif(answer, ''),
  nullif(array_to_string({sql.tokens("question")}, ' '), '')) AS text FROM qa_pairs""",
)
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.qa_pairs(spark, sf).withColumn("keywords", tokens("question"))
    return rows.select(
        "id", essays.embedding_text("question", "answer", "keywords").alias("text")
    )


# --- skills and keywords ------------------------------------------------------------------

# Cue words that occur in the driver's texts.
CORPUS_CUES = skills.Cues(must=("with the", "for the"), nice=("from", "by the"), either=("or",))


def corpus_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """All longer terms of the corpus as skills, their first letter as the role."""
    words = b.documents(spark, sf).select(F.explode(skills.words("text")).alias("w"))
    longer = words.where((F.length("w") > 3) & (F.col("w") != "from") & (F.col("w") != "with"))
    # written, so that what is made of a word is made once a word
    return written(longer.distinct(), "words").select(
        F.col("w").alias("surface"),
        F.concat(F.lit("skill "), "w").alias("skill"),
        F.substring("w", 1, 1).alias("role"),
    )


_WORD_SQL = sql.quote(skills.WORD)
_SEG_SQL = sql.quote(skills.SEGMENT_END)


def _cue_sql(cues) -> str:
    pattern = "|".join(cues)
    return (
        "regexp_matches(' ' || lower(segment) || ' ', "
        + sql.quote(rf"[^\p{{L}}\p{{N}}](?:{pattern})[^\p{{L}}\p{{N}}]")
        + ")"
    )


SKILLS_SQL = f"""WITH freq AS (SELECT DISTINCT w FROM (
    SELECT unnest(regexp_extract_all(lower(text), {_WORD_SQL})) AS w FROM documents)
  WHERE length(w) > 3 AND w NOT IN ('from', 'with')),
segs AS (SELECT doc_id, unnest(s) AS segment, generate_subscripts(s, 1) AS seg FROM (
  SELECT doc_id, regexp_split_to_array(text, {_SEG_SQL}) AS s FROM documents)),
marked AS (SELECT doc_id, seg, CASE WHEN {_cue_sql(CORPUS_CUES.nice)} THEN 'nice'
    WHEN {_cue_sql(CORPUS_CUES.must)} THEN 'must' END AS mark,
    regexp_extract_all(lower(segment), {_WORD_SQL}) AS w FROM segs),
sections AS (SELECT doc_id, seg, w, last_value(mark IGNORE NULLS) OVER (
    PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM marked),
toks AS (SELECT doc_id, seg, section, unnest(w) AS tok, generate_subscripts(w, 1) AS pos
  FROM sections),
chained AS (SELECT *, lag(tok) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS before FROM toks),
hits AS (SELECT c.*, 'skill ' || tok AS skill, left(tok, 1) AS role FROM chained c JOIN freq f
  ON f.w = c.tok WHERE section IS NOT NULL),
joined AS (SELECT *, CASE WHEN lag(pos) OVER s = pos - 2 AND (before = 'or'
    OR (before = '/' AND lag(role) OVER s = role)) THEN 0 ELSE 1 END AS opened FROM hits
  WINDOW s AS (PARTITION BY doc_id, section, seg ORDER BY pos)),
grouped AS (SELECT *, sum(opened) OVER (PARTITION BY doc_id, section ORDER BY seg, pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM joined),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, skill ORDER BY seg, pos)
    AS copy FROM grouped),
alts AS (SELECT doc_id, section, g, string_agg(skill, '|' ORDER BY seg, pos) AS part
  FROM firsts WHERE copy = 1 GROUP BY doc_id, section, g)
SELECT doc_id, coalesce(string_agg(part, ';' ORDER BY g) FILTER (section = 'must'), '') AS must,
  coalesce(string_agg(part, ';' ORDER BY g) FILTER (section = 'nice'), '') AS nice
FROM alts GROUP BY doc_id"""


def groups_text(c: str):
    return F.array_join(F.transform(c, lambda g: F.array_join(g, "|")), ";")


@query("extract_skills", SKILLS_SQL)
def extract_skills(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.documents(spark, sf).select("doc_id", "text")
    found = skills.extract_skills(
        docs, corpus_dictionary(spark, sf), CORPUS_CUES, "doc_id", "text"
    )
    return found.select(
        "doc_id",
        groups_text("must_have_skills").alias("must"),
        groups_text("nice_to_have_skills").alias("nice"),
    )


@query(
    "extract_keywords",
    f"""WITH toks AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term NOT IN {sql.STOPS} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT doc_id, term, round(tf * (ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE)
    / CAST(df + 1 AS DOUBLE)) + CAST(1 AS DOUBLE)), 9) AS score FROM tf JOIN df USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS k
  FROM scored)
SELECT doc_id, string_agg(term, '|' ORDER BY k) AS keywords FROM ranked WHERE k <= 10
GROUP BY doc_id""",
)
def extract_keywords(spark: SparkSession, sf: str) -> DataFrame:
    found = keywords.extract_keywords(b.documents(spark, sf), "doc_id", "text")
    return found.select("doc_id", F.array_join("keywords", "|").alias("keywords"))


# --- CV text ------------------------------------------------------------------------------


def _redact_sql() -> str:
    steps, counts, source = [], [], "SELECT doc_id, coalesce(text, '') AS t FROM documents"
    for name, pattern in prose.PII_PATTERNS.items():
        p = sql.quote(pattern)
        kept = "\\1" if prose.bordered(pattern) else ""  # what stood before is put back
        steps.append(
            f"{name}_step AS (SELECT * REPLACE (regexp_replace(t, {p}, '{kept}[removed]', 'g') AS t), "
            f"len(regexp_extract_all(t, {p})) AS n_{name} FROM ({source}))"
        )
        counts.append(f"n_{name}")
        source = f"SELECT * FROM {name}_step"
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {sql.trim('t')} AS clean, "
        + ", ".join(counts) + f", {sql.trim('t')} <> '' AS ok FROM ({source})"
    )


@query("redact_pii", _redact_sql())
def redact_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.documents(spark, sf).select("doc_id", "text")
    return prose.redact_pii(docs, "text", "[removed]").drop("text")


@query(
    "reflow_paragraphs",
    f"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, {sql.trim("line")} AS line, i FROM (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM parts)),
ahead AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM lines WHERE line <> ''),
joined AS (SELECT doc_id, string_agg(line || CASE WHEN following IS NULL THEN ''
    WHEN regexp_matches(line, '[.!?]$') AND regexp_matches(following, '^\\p{{Lu}}')
    THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY i) AS t FROM ahead GROUP BY doc_id)
SELECT d.doc_id, coalesce({sql.trim("regexp_replace(t, ' +', ' ', 'g')")}, '') AS reflowed
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id""",
)
def reflow_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.documents(spark, sf).select("doc_id", "text")
    return prose.reflow_paragraphs(docs, "text").drop("text")
