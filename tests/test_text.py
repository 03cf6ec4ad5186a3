"""Essays, skills, keywords and CV text on small rows."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from vacanta.functions import arrays
from vacanta.functions.text import singular, strip, tokens
from vacanta.operators import essays, keywords, prose, skills
from vacanta.operators.embed import backfill_embeddings, embed
from vacanta.plans.job_run import upload_cvs
from vacanta.schemas import ESSAY


def one(spark, value, ddl, expr):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text,question,answer,valid",
    [
        ("Question: Why?\nAnswer: Because.", "Why?", "Because.", True),
        ("answer: only", None, "only", True),
        ("Question:\nAnswer: My answer here", None, "My answer here", True),
        (
            "Question: How do you Answer: questions?\nAnswer: I think carefully.",
            "How do you Answer: questions?", "I think carefully.", True,
        ),
        ("QUESTION: a question: b ANSWER:  c ", "a question: b", "c", True),
        ("Question: lost", None, None, False),
        ("Question: q Answer:  \n", "q", "", False),
        ("", None, None, False),
    ],
)
def test_parse_qa(spark, text, question, answer, valid):
    row = essays.parse_qa_text(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.question, row.answer, row.valid) == (question, answer, valid)


def test_strip_equals_python(spark):
    text = "\t\n\x0b\x1c\x85\xa0 　 a b   "
    assert one(spark, text, "t string", strip("t")) == text.strip() == "a b"


def test_tokens_and_singular(spark):
    assert one(spark, "Ünï-Code's  C3PO!", "t string", tokens("t")) == ["ünï", "code", "s", "c3po"]
    for word, want in {"pipelines": "pipeline", "stories": "story", "class": "class", "gas": "gas", "ties": "tie"}.items():
        assert one(spark, word, "t string", singular("t")) == want


SKILLS = "s array<array<string>>"


@pytest.mark.parametrize(
    "groups,text",
    [
        (None, ""),
        ([], ""),
        ([["React"]], "React"),
        ([["JavaScript", "Python"], ["React"]], "JavaScript or Python, React"),
        ([[f"S{i}"] for i in range(15)], ", ".join(f"S{i}" for i in range(10)) + " ... and 5 more"),
        (
            [[f"{g}{i}" for i in (1, 2, 3)] for g in "ABCD"],
            "A1 or A2 or A3, B1 or B2 or B3, C1 or C2 or C3, D1 ... and 2 more",
        ),
        ([[], ["X"], []], "X"),
    ],
)
def test_format_skills(spark, groups, text):
    assert one(spark, groups, SKILLS, arrays.format_skills("s")) == text


def test_skill_layouts(spark):
    assert one(spark, ["A", "B"], "s array<string>", arrays.skills_1d_to_2d("s")) == [["A"], ["B"]]
    assert one(spark, [], "s array<string>", arrays.skills_1d_to_2d("s")) is None
    assert one(spark, [["A", "B"], ["C"]], SKILLS, arrays.skills_2d_to_1d("s")) == ["A", "B", "C"]
    assert one(spark, [], SKILLS, arrays.skills_2d_to_1d("s")) is None


def test_normalise_keywords(spark):
    raw = [" Python ", "", "python", "SQL", "  ", "PYTHON", "sql", *[f"k{i}" for i in range(20)]]
    got = one(spark, raw, "k array<string>", arrays.normalise_keywords("k"))
    assert got == ["Python", "SQL", *[f"k{i}" for i in range(8)]]
    assert one(spark, None, "k array<string>", arrays.normalise_keywords("k")) == []


@pytest.mark.parametrize(
    "text,must,nice",
    [
        ("Required skills: Ruby, Flask, MySQL. Preferred: Memcached, GCP.",
         [["Ruby"], ["Flask"], ["MySQL"]], [["Memcached"], ["GCP"]]),
        ("Обов'язково: Vue, Rust, Terraform; буде плюсом: REST.",
         [["Vue"], ["Rust"], ["Terraform"]], [["REST"]]),
        ("You must know CI/CD (GitHub Actions) and Kubernetes; Ansible would be great.",
         [["CI/CD"], ["GitHub Actions"], ["Kubernetes"]], [["Ansible"]]),
        ("Requirements: Go or Rust, Angular or Vue, and Terraform.",
         [["Go", "Rust"], ["Angular", "Vue"], ["Terraform"]], []),
        ("We expect Java/Go, MongoDB/MySQL, and GCP.",
         [["Java", "Go"], ["MongoDB", "MySQL"], ["GCP"]], []),
        ("Proficient in Ruby/Django, and CSS/SQL.",
         [["Ruby"], ["Django"], ["CSS"], ["SQL"]], []),
        ("Desirable: some Postgres/MySQL next to Docker/Terraform.",
         [], [["PostgreSQL", "MySQL"], ["Docker"], ["Terraform"]]),
        ("Advantageous: TypeScript/Vue, GCP/EC2 in daily work.",
         [], [["TypeScript"], ["Vue"], ["GCP"], ["EC2"]]),
        ("Required:\n- GraphQL\n- Google BigQuery\n- TS and TypeScript\nPreferred:\n- Memcached or Redis",
         [["GraphQL"], ["Google BigQuery"], ["TypeScript"]], [["Memcached", "Redis"]]),
    ],
)
def test_extract_skills(spark, text, must, nice):
    jobs = spark.createDataFrame([(1, text)], "arrival bigint, description string")
    row = skills.extract_skills(jobs, skills.dictionary(spark)).first()
    assert (row.must_have_skills, row.nice_to_have_skills) == (must, nice)


def test_no_skills_without_cue_or_text(spark):
    jobs = spark.createDataFrame([(1, "We use Python."), (2, None), (3, "")], "arrival bigint, description string")
    assert skills.extract_skills(jobs, skills.dictionary(spark)).count() == 0


def test_skill_match(spark):
    df = spark.createDataFrame(
        [(1, [["A", "B"], ["C"]], ["B"]), (2, [["A", "B"]], ["A", "Z"]), (3, None, None), (4, [["A"]], None)],
        "id int, need array<array<string>>, have array<string>",
    )
    got = {r.id: (r.matched, r.total, r.all_matched) for r in skills.skill_match(df, "need", "have").collect()}
    assert got == {1: (1, 2, False), 2: (1, 1, True), 3: (0, 0, True), 4: (0, 1, False)}


def test_extract_keywords_ranks_rare_terms(spark):
    docs = spark.createDataFrame(
        [(1, "spark spark shuffle the the"), (2, "shuffle data"), (3, "  "), (4, "data data lake")],
        "id bigint, text string",
    )
    got = {r.id: r.keywords for r in keywords.extract_keywords(docs, n=2).collect()}
    assert got == {1: ["spark", "shuffle"], 2: ["data", "shuffle"], 4: ["data", "lake"]}


def reference_reflow(text):
    """The paragraph rule, line by line."""
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    out = ""
    for i, line in enumerate(lines):
        out += line
        if i + 1 < len(lines):
            ends = line[-1] in ".!?" and lines[i + 1][0].isupper()
            out += "\n\n" if ends else " "
    return re.sub(" +", " ", out).strip()


@pytest.mark.parametrize(
    "text",
    [
        "", " \n\t\n", "One line", "Ends here.\nNext starts.\nand goes on\nDone!",
        "SKILLS\nPython,  SQL\n\nWorked at Acme.\nÉcole: Paris?\nyes", "a.\r\nB.\nc",
    ],
)
def test_reflow(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert prose.reflow_paragraphs(df, "t").first().reflowed == reference_reflow(text)


CV = """Marit keeps a lighthouse, 2009 - 2014
marit.voss@harbour.example | +47 555 20 304 | www.harbour.example/marit github.com/mvoss
Born on 17.04.1985, number 219-09-9999
Sea School, 2003-2008, mark 1.7/6.0, radio licence, release 4.12"""


def test_redact_pii(spark):
    row = prose.redact_pii(spark.createDataFrame([(CV,)], "t string"), "t", "#").first()
    for secret in ("@", "555", "www", "github", "1985", "9999"):
        assert secret not in row.clean
    for kept in ("Marit", "2009 - 2014", "Sea School, 2003-2008", "1.7/6.0", "release 4.12"):
        assert kept in row.clean
    assert (row.n_email, row.n_phone, row.n_url, row.n_birth, row.n_national_id) == (1, 1, 2, 1, 1)
    assert row.ok


KEPT = [
    "Manage 5 engineers; coverage 95%; storage: 10 TB; page 12; average 40 ms",
    "A budget of 10 000 000 and 1,250,000 more", "Host 192.168.10.25, port 8080, release 3.13.1",
    "From 2015-2019 to 2024-01-15", "Rooms 12-14, lines 100-200", "reborn 1999 teenage 3",
]
REMOVED = [
    ("Call 040 123 4567 now", "Call # now"), ("(040) 123-4567", "#"), ("+49 170 1234567.", "#."), ("tel 01701234567", "tel #"),
    ("age: 31, aged 40", "#, #"), ("dob 1.2.1990", "#"), ("(123-45-6789)", "(#)"),
]


def test_redact_pii_borders(spark):
    cases = [(t, t) for t in KEPT] + REMOVED
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.clean for r in prose.redact_pii(frame, "t", "#").collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_redact_marks_blank_input_and_output(spark):
    df = spark.createDataFrame([(None,), (" ",), ("a@b.co",), ("x",)], "t string")
    assert [r.ok for r in prose.redact_pii(df, "t").collect()] == [False, False, False, True]


def test_redact_names_isolates_failures(spark):
    def make_model():
        def model(texts):
            if "bad" in texts[0]:
                raise RuntimeError("no")
            return [texts[0].replace("John", "").strip()]

        return model

    df = spark.createDataFrame([(1, "John codes"), (2, "bad"), (3, None)], "id int, t string")
    got = {r.id: r.t for r in prose.redact_names(df, "t", make_model).collect()}
    assert got == {1: "codes", 2: None, 3: None}


def test_previews(spark):
    df = spark.createDataFrame(
        [(1, "Q?", "x" * 501, ["a", "b"]), (2, None, "short", []), (3, "", "y" * 100, None)],
        "id int, question string, answer string, keywords array<string>",
    )
    got = {r.id: r for r in essays.result_preview(df, "id").collect()}
    assert got[1].search_preview == "**Question:** Q?\n**Answer:** " + "x" * 500 + "...\n**Keywords:** a, b"
    assert got[1].list_preview == "1. Q: Q?\nA: " + "x" * 100 + "...\nKeywords: a, b"
    assert got[2].search_preview == "**Answer:** short\n**Keywords:** No keywords"
    assert got[2].list_preview == "2. A: short" and got[3].list_preview == "3. A: " + "y" * 100


def test_embedding_text(spark):
    df = spark.createDataFrame(
        [("q", "a", ["k1", "k2"]), ("", "a", []), (None, "a", None)],
        "question string, answer string, keywords array<string>",
    )
    got = [r.x for r in df.select(essays.embedding_text("question", "answer", "keywords").alias("x")).collect()]
    assert got == ["q a k1 k2", "a", "a"]


NOW = "2024-02-01 00:00:00"
OLD = dt.datetime(2024, 1, 1)


def stored_essays(spark):
    return spark.createDataFrame(
        [(1, "q1", "a1", ["k"], None, OLD, OLD), (2, None, "a2", None, [1.0, 0.0], OLD, OLD)], ESSAY
    )


CHANGES = "id bigint, question string, answer string, keywords array<string>, supplied array<string>"


def test_partial_updates(spark):
    updates = spark.createDataFrame(
        [(1, None, None, None, ["question"]), (2, "x", "new", None, ["answer"]), (0, "z", None, None, ["question"]), (9, "z", None, None, ["question"])],
        CHANGES,
    )
    got = {r.id: r for r in essays.update_essays(stored_essays(spark), updates, NOW).collect()}
    assert (got[1].question, got[1].answer, got[1].keywords) == (None, "a1", ["k"])
    assert (got[2].question, got[2].answer) == (None, "new")
    assert got[1].updated_at == dt.datetime(2024, 2, 1) and got[1].created_at == OLD
    bad = spark.createDataFrame([(1, None, None, None, ["answer"])], CHANGES)
    with pytest.raises(Exception, match="Answer is required"):
        essays.update_essays(stored_essays(spark), bad, NOW).collect()


def test_set_values(spark):
    new = spark.createDataFrame([(1, [0.5]), (9, [1.0])], "id bigint, embedding array<double>")
    got = {r.id: r for r in essays.set_values(stored_essays(spark), new, "embedding", NOW).collect()}
    assert got[1].embedding == [0.5] and got[1].updated_at == dt.datetime(2024, 2, 1)
    assert got[2].embedding == [1.0, 0.0] and got[2].updated_at == OLD and set(got) == {1, 2}


def test_create_and_delete(spark):
    creates = spark.createDataFrame(
        [(2, None, "second", None), (1, "q", "first", ["k"])],
        "pos bigint, question string, answer string, keywords array<string>",
    )
    out = essays.create_essays(stored_essays(spark), creates, NOW, "pos")
    assert {r.id: r.answer for r in out.collect()} == {1: "a1", 2: "a2", 3: "first", 4: "second"}
    ids = spark.createDataFrame([(2,), (-1,), (99,)], "id bigint")
    assert [r.id for r in essays.delete_essays(stored_essays(spark), ids).collect()] == [1]
    with pytest.raises(Exception, match="Answer is required"):
        essays.create_essays(
            stored_essays(spark), creates.withColumn("answer", F.lit(None).cast("string")), NOW, "pos"
        ).collect()


def test_hashed_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "B b A"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.embedding for r in embed(df, "t", 16).collect()}
    assert got[1] == got[2] and len(got[1]) == 16
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6)
    assert got[3] == [0.0] * 16 and got[4] is None


def make_length_model():
    def model(texts):
        if any(t is None or "bad" in t for t in texts):
            raise RuntimeError("model failed")
        return [[float(len(t)), 1.0] for t in texts]

    return model


def test_model_embedding_keeps_good_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None)], "id int, t string").coalesce(1)
    got = {r.id: r.embedding for r in embed(df, "t", 2, make_length_model).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None}


def test_backfill_only_missing_or_all(spark):
    got = {r.id: r.embedding for r in backfill_embeddings(stored_essays(spark), 2, make_length_model).collect()}
    assert got == {1: [7.0, 1.0], 2: [1.0, 0.0]}
    every = backfill_embeddings(stored_essays(spark), 2, make_length_model, only_missing=False)
    assert {r.id: r.embedding for r in every.collect()} == {1: [7.0, 1.0], 2: [2.0, 1.0]}


def test_cv_upload(spark):
    ddl = "user_id bigint, text string, uploaded_at timestamp"
    base = embed(spark.createDataFrame([(1, "old cv", OLD), (2, "kept", OLD)], ddl), "text", 8)
    late = dt.datetime(2024, 1, 2)
    uploads = spark.createDataFrame([(1, "Engineer\nme@x.org", late), (3, "x@y.zz", late)], ddl)
    cvs, errors = upload_cvs(base, uploads, 8, reflow=True)
    got = {r.user_id: r for r in cvs.collect()}
    assert got[1].text == "Engineer" and got[2].text == "kept" and len(got[1].embedding) == 8
    assert [r.user_id for r in errors.collect()] == [3]


def test_only_words_in_a_section_meet_the_dictionary(spark):
    text = "redis first. Required: python or java. Then go / rust.\nNice to have: aws, aws lambda"
    jobs = spark.createDataFrame([(1, text), (2, "python everywhere"), (None, "must sql")], "arrival bigint, description string")
    hits = skills.skill_hits(jobs, skills.dictionary(spark))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(section" in plan[plan.index("Join"):]
    got = {r.arrival: r for r in skills.extract_skills(jobs, skills.dictionary(spark)).collect()}
    assert got.keys() == {1, None}
    assert got[1].must_have_skills == [["Python", "Java"], ["Go", "Rust"]]
    assert got[1].nice_to_have_skills == [["AWS"], ["AWS Lambda"]]
    assert got[None].must_have_skills == [["SQL"]] and got[None].nice_to_have_skills == []


def test_keywords_go_on_from_written_tables(spark):
    """Checkpoints kept every row as it is in memory, and the join that followed took most of the time."""
    rows = [(1, "spark joins spark"), (1, "spark"), (2, "joins and"), (None, "window"), (3, "of the")]
    found = keywords.extract_keywords(spark.createDataFrame(rows, "id bigint, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [id" in plan
    assert sorted(((r.id, r.keywords) for r in found.collect()), key=str) == [
        (1, ["spark", "joins"]), (2, ["joins"]), (None, ["window"]),
    ]
