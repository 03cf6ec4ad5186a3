"""Sources, versioned tables and streams on small files."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vacanta.operators import search
from vacanta.operators.embed import embed
from vacanta.plans.job_run import RunSettings, run_batch
from vacanta.schemas import ESSAY_CHANGE, KEYED_JOB, STORED_JOB, struct, LONG, TEXT, TIME
from vacanta.session import scratch_path, shuffles_released
from vacanta.sources import cvs as cv_files
from vacanta.sources import postings, tables
from vacanta.streaming import essays as essay_streams
from vacanta.streaming import jobs as job_streams

NOW = "2024-01-20 00:00:00"


def job(i, **more):
    return {
        "job_id": i, "title": f"T{i}", "url": f"u{i}", "source": "s", "description": f"work {i}",
        "company": {"name": f"C{i}"}, "date_posted": "2024-01-15T10:00:00Z",
        "valid_through": "2024-02-15T10:00:00Z", "experience_months": 12.0,
        "location": {"region": "R", "can_apply": True}, **more,
    }


def message(sequence, jobs=None, rid="r1", **more):
    out = {"correlation_id": rid, "sequence": sequence, "success": True, "is_complete": False}
    if jobs is not None:
        out.update(jobs=jobs, jobs_count=len(jobs))
    return {**out, **more}


def write_files(folder, groups):
    """One file per group of messages, in name and time order."""
    import os

    folder.mkdir(exist_ok=True)
    for i, group in enumerate(groups):
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(m) for m in group))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_read_jobs_json(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps(job(1)) + "\n" + json.dumps({"job_id": 2}) + "\n")
    got = postings.read_jobs_json(spark, str(tmp_path)).orderBy("job_id").collect()
    assert got[0].company.name == "C1" and got[0].location.can_apply is True
    assert got[1].title is None and got[1].salary is None


def test_explode_envelopes(spark, tmp_path):
    path = write_files(
        tmp_path / "in",
        [[message(1, [job(1), job(2)]), message(2), message(3, [job(9)], rid="other"),
          message(4, success=False, error="blocked"), message(5, success=False)]],
    )
    envelopes = postings.read_envelopes(spark, path)
    jobs, errors = postings.explode_envelopes(envelopes, "r1")
    got = jobs.orderBy("arrival").collect()
    assert [(r.job_id, r.position) for r in got] == [(1, 0), (2, 1)]
    assert sorted(r.error for r in errors.collect()) == ["Unknown error", "blocked"]
    with pytest.raises(Exception, match="Scraper error"):
        postings.explode_envelopes(envelopes, "r1", strict=True)[0].collect()


def test_jobs_of_envelopes_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    path = write_files(
        tmp_path / "in", [[message(2, [job(5)]), message(1, [job(1), job(2)])], [message(3), message(0, [job(9)])]]
    )
    envelopes = postings.read_envelopes(spark, path)
    plans, numbers = [], []
    for few in (4, 3):
        monkeypatch.setattr(postings, "FEW_ENVELOPES", few, raising=False)
        jobs, _ = postings.explode_envelopes(envelopes, "r1")
        numbers.append([(r.arrival, r.job_id, r.position) for r in jobs.orderBy("arrival").collect()])
        plans.append(jobs._jdf.queryExecution().executedPlan().toString())
    assert numbers[0] == numbers[1] == [(1, 9, 0), (2, 1, 0), (3, 2, 1), (4, 5, 0)]
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin [_read" not in plans[1]
    # nothing wide is dealt out: no exchange holds the jobs
    assert not any("Exchange hashpartitioning(_read" in x and "jobs" in x for x in plans[0].splitlines())


def test_shuffle_files_go_when_an_execution_ends(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count()
    with shuffles_released(spark):
        assert spark.conf.get(name) == "true"
        counted.write.parquet(str(tmp_path / "a"))
        assert len(counted.collect()) == len(counted.collect()) == spark.read.parquet(str(tmp_path / "a")).count() == 7
    assert spark.conf.get(name) == before


def test_snapshots_are_compressed_tables(spark, tmp_path):
    tables.store_snapshot(spark.range(9), str(tmp_path / "t"), 1)
    assert {".zstd." in p.name for p in tmp_path.glob("t/v=*/part-*")} == {True}


def test_read_cv_texts(spark, tmp_path):
    (tmp_path / "cv_7.txt").write_text("line one\nlinia druga ü", encoding="utf-8")
    (tmp_path / "cv_8.txt").write_text("")
    (tmp_path / "cv_9.pdf").write_text("ignored")
    got = {r.user_id: r for r in cv_files.read_cv_texts(spark, str(tmp_path)).collect()}
    assert got[7].text == "line one\nlinia druga ü" and got[7].error is None
    assert 9 not in got


def test_cv_files_take_no_folder_of_their_own(spark, tmp_path):
    path = (tmp_path / "cvs").as_uri()
    rows = [(i, f"cv {i} ü\n") for i in range(600)] + [(3, "cv 3 ü\n"), (None, "nobody"), (-4, "below"), (700, None)]
    cv_files.write_cv_texts(spark.createDataFrame(rows, "user_id bigint, text string"), path)
    got = [(r.user_id, r.text) for r in cv_files.read_cv_texts(spark, path, cv_files.USER_FILE).collect()]
    expected = [(i, f"cv {i} ü\n\n") for i in range(600) if i != 3]
    expected += [(3, "cv 3 ü\n\n" * 2), (700, "\n"), (None, "nobody\n"), (None, "below\n")]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(p.is_dir() for p in (tmp_path / "cvs").rglob("*")) <= cv_files.FOLDERS


def test_cv_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cv_files, "FILES_PER_TASK", 50)
    for i in range(120):
        folder = tmp_path / f"{i % 3}" / ("deep" if i % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"cv_{i}.txt").write_bytes(b"cv %d \xff\r\n" % i)
    for name in (".cv_200.txt", "_cv_201.txt", "cv_202.pdf", "_gone/cv_203.txt", ".gone/cv_204.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("not read")
    (tmp_path / "cv_300.txt").write_text("")
    read = cv_files.read_cv_texts(spark, str(tmp_path))
    got = {r.user_id: (bytes(r.raw), r.error) for r in read.withColumn("raw", F.col("text").cast("binary")).collect()}
    wrong = got.pop(300)
    assert got == {i: (b"cv %d \xff\r\n" % i, None) for i in range(120)}
    assert wrong == (b"", "Failed to extract content from CV file")
    assert read.where("user_id = 7").first().uploaded_at.timestamp() == pytest.approx(
        (tmp_path / "1" / "deep" / "cv_7.txt").stat().st_mtime, abs=0.002
    )
    # nothing of a file is kept on the driver, and a task gets its share whatever the sizes
    assert "FileScan text" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="Failed to extract"):
        cv_files.read_cv_texts(spark, str(tmp_path), strict=True).collect()


def test_snapshot_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.store_snapshot(spark.range(3), path, 1)
    broken = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error("boom").cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        tables.store_snapshot(broken, path, 2)
    assert tables.committed_versions(spark, path) == [1]
    assert tables.read_store(spark, path).count() == 3
    with pytest.raises(ValueError):
        tables.store_snapshot(spark.range(1), path, 1)
    tables.store_snapshot(spark.range(5), path, 1, replay=True)
    assert tables.read_store(spark, path).count() == 5
    assert tables.read_store(spark, path, struct(id=LONG), before=1).count() == 0


def test_read_current_takes_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "id bigint, x string, deleted boolean"
    tables.store_snapshot(spark.createDataFrame([(1, "a", False), (2, "b", False)], ddl), path, 0)
    tables.store_snapshot(spark.createDataFrame([(1, "c", False), (2, "b", True)], ddl), path, 1)
    got = tables.read_current(spark, path, "id", deleted="deleted").collect()
    assert [(r.id, r.x) for r in got] == [(1, "c")]
    first = tables.read_current(spark, path, "id", before=1, only=spark.range(2, 3))
    assert [(r.id, r.x) for r in first.collect()] == [(2, "b")]


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "id bigint, x string, month string"
    for v, rows in enumerate([[(1, "a", "01"), (2, "b", "02")], [(1, "c", "01")], [(3, "d", "03")]]):
        tables.store_snapshot(spark.createDataFrame(rows, ddl), path, v, partition_by=["month"])
        if v == 1:
            assert tables.compact(spark, path, 1, ["month"]) == 1
    read = lambda **kw: sorted((r.id, r.x, r[tables.VERSION]) for r in tables.read_store(spark, path, **kw).collect())
    assert read() == [(1, "a", 0), (1, "c", 1), (2, "b", 0), (3, "d", 2)]
    assert read(before=1) == [(1, "a", 0), (2, "b", 0)]
    current = tables.read_current(spark, path, "id")
    assert {r.month for r in current.collect()} == {"01", "02", "03"}
    assert sorted((r.id, r.x) for r in current.collect()) == [(1, "c"), (2, "b"), (3, "d")]


# --- the job stream --------------------------------------------------------------------------

BATCHES = [
    [job(1), job(2, experience_months=99.0), job(3, url="u1")],
    [job(1), job(4), job(5, title="T4", company={"name": "C4"}), job(6, location={"can_apply": False})],
    [job(4, source="other"), job(7), job(8, title="T1", company={"name": "C1"}), job(2)],
]


def cv_table(spark):
    return embed(spark.createDataFrame([(0, "work on things")], "user_id bigint, text string"), "text", 16)


def target(spark):
    return job_streams.JobTables(*[scratch_path(spark, n) for n in ("store", "totals", "progress")])


def run_stream(spark, folder, where, timeout_s=300.0, files_per_batch=1):
    job_streams.stream_jobs(
        job_streams.envelope_stream(spark, folder, files_per_batch),
        "r1", where, cv_table(spark), RunSettings(now=NOW, dim=16), timeout_s=timeout_s,
    )


def stored_rows(spark, path):
    rows = tables.read_store(spark, path, STORED_JOB).collect()
    return sorted((r.external_id, r.source, r.is_filtered, r.is_relevant) for r in rows)


def test_stream_equals_batch_after_batch(spark, tmp_path):
    groups = [[message(i, jobs)] for i, jobs in enumerate(BATCHES)] + [[message(3, [], is_complete=True)]]
    where = target(spark)
    run_stream(spark, write_files(tmp_path / "in", groups), where)

    store = spark.createDataFrame([], STORED_JOB)
    for i, jobs in enumerate(BATCHES):
        one = spark.createDataFrame([message(i, jobs)], postings.ENVELOPE)
        raw = postings.explode_envelopes(one)[0].withColumn("user_id", F.lit(0).cast("bigint"))
        result = run_batch(raw, store, cv_table(spark), RunSettings(now=NOW, dim=16))
        store = store.unionByName(result.new_rows.select(*STORED_JOB.names)).checkpoint()
    want = sorted((r.external_id, r.source, r.is_filtered, r.is_relevant) for r in store.collect())
    assert stored_rows(spark, where.store) == want
    # 3 repeats the URL of 1; the last 4 and 8 repeat an active title and company; 2 is known
    # as rejected
    assert [w[0] for w in want] == ["1", "2", "4", "5", "6", "7"]
    names = tables.read_store(spark, where.names).collect()
    by_id = {(r.dimension, r.id): r.name for r in names}
    assert len(by_id) == len(names) == len({(r.dimension, r.name) for r in names})
    for r in tables.read_store(spark, where.store, KEYED_JOB).collect():
        assert by_id["company_name", r.company_id] == r.company_name
        assert by_id["location_region", r.location_id] == r.location_region if r.location_region else r.location_id is None
    totals = job_streams.totals_so_far(spark, where.summaries).orderBy("batch_no").collect()
    assert [(t.total_scraped, t.scraped_so_far, t.total_filtered) for t in totals][:3] == [
        (3, 3, 2), (4, 7, 2), (4, 11, 1),
    ]


def test_a_run_joins_and_numbers_keys_without_job_bodies(spark, monkeypatch):
    """The wide rows meet what was decided once; before, numbering, relevance and insertion each moved them."""
    from vacanta.plans import job_run

    seen = {}

    def noted(module, name):
        whole = getattr(module, name)

        def call(rows, *args, **more):
            seen[name] = set(rows.columns)
            return whole(rows, *args, **more)

        monkeypatch.setattr(module, name, call)

    noted(postings, "number_rows")
    noted(job_run, "route_and_store")
    one = spark.createDataFrame([message(0, [job(1), job(2)]), message(1, []), message(2, [job(3)])], postings.ENVELOPE)
    raw = postings.explode_envelopes(one)[0].withColumn("user_id", F.lit(0).cast("bigint"))
    assert sorted((r.arrival, r.position, r.job_id) for r in raw.collect()) == [(1, 0, 1), (2, 1, 2), (3, 0, 3)]
    result = run_batch(raw, spark.createDataFrame([], STORED_JOB), cv_table(spark), RunSettings(now=NOW, dim=16))
    assert sorted(r.description for r in result.new_rows.collect()) == ["work 1", "work 2", "work 3"]
    assert not seen["number_rows"] & {"job", "jobs"} and "description" not in seen["route_and_store"]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    groups = [[message(i, jobs)] for i, jobs in enumerate(BATCHES)] + [[message(3, [], is_complete=True)]]
    folder = write_files(tmp_path / "in", groups)
    where = target(spark)
    run_stream(spark, folder, where)
    before = stored_rows(spark, where.store)
    # progress lost: every batch is delivered again under its old id
    again = job_streams.JobTables(where.store, where.summaries, scratch_path(spark, "progress"))
    run_stream(spark, folder, again)
    assert stored_rows(spark, where.store) == before


def test_error_response_fails_the_stream(spark, tmp_path):
    folder = write_files(tmp_path / "in", [[message(0, [job(1)])], [message(1, success=False, error="blocked")]])
    where = target(spark)
    with pytest.raises(Exception, match="blocked"):
        run_stream(spark, folder, where)
    assert [r[0] for r in stored_rows(spark, where.store)] == ["1"]


def test_missing_completion_is_a_timeout(spark, tmp_path):
    folder = write_files(tmp_path / "in", [[message(1, [job(1)])]])
    with pytest.raises(TimeoutError):
        run_stream(spark, folder, target(spark))


def test_lost_message_is_a_timeout_though_the_completion_came(spark, tmp_path):
    folder = write_files(tmp_path / "in", [[message(0, [job(1)])], [message(2, [], is_complete=True)]])
    where = target(spark)
    with pytest.raises(TimeoutError):
        run_stream(spark, folder, where)
    assert [r[0] for r in stored_rows(spark, where.store)] == ["1"]


def test_live_stream_waits_for_messages_behind_the_completion(spark, tmp_path):
    import threading
    import time

    folder = write_files(tmp_path / "in", [[message(2, [], is_complete=True)], [message(0, [job(1)])]])
    late = threading.Timer(12, lambda: (tmp_path / "in" / "late.json").write_text(json.dumps(message(1, [job(2)]))))
    late.start()
    where, start = target(spark), time.monotonic()
    job_streams.stream_jobs(
        job_streams.envelope_stream(spark, folder, 1), "r1", where, cv_table(spark),
        RunSettings(now=NOW, dim=16), timeout_s=200, available_now=False,
    )
    assert [r[0] for r in stored_rows(spark, where.store)] == ["1", "2"]
    assert 12 <= time.monotonic() - start < 120


def test_timer_ends_a_live_stream(spark, tmp_path):
    folder = write_files(tmp_path / "in", [[message(0, [job(1)])], [message(5, [], rid="other", is_complete=True)]])
    with pytest.raises(TimeoutError):
        job_streams.stream_jobs(
            job_streams.envelope_stream(spark, folder), "r1", target(spark), cv_table(spark),
            RunSettings(now=NOW, dim=16), timeout_s=10, available_now=False,
        )


def test_ranges_of_sequence_numbers():
    from vacanta.streaming.state import add_place

    for seed in range(50):
        order = random.Random(seed).choices(range(12), k=30)
        starts, ends = [], []
        for place in order:
            add_place(starts, ends, place)
        got = {p for s, e in zip(starts, ends) for p in range(s, e)}
        assert got == set(order) and all(e < s for e, s in zip(ends, starts[1:]))


def test_stream_dedupe_across_batches(spark, tmp_path):
    schema = struct(arrival=LONG, source=TEXT, source_url=TEXT, posted_at=TIME)
    at = "2024-01-15T00:00:00Z"
    row = lambda i, s, u: {"arrival": i, "source": s, "source_url": u, "posted_at": at}
    folder = write_files(
        tmp_path / "in",
        [[row(1, "a", "u1"), row(2, "a", "u1"), row(3, "b", "u1"), row(4, "a", "old"), row(5, "a", None)],
         [row(6, "a", "u1"), row(7, "a", "u2"), row(8, "a", "stale"), row(9, None, "u9"), row(10, None, "u9")]],
    )
    store = spark.createDataFrame(
        [("a", "old", dt.datetime(2024, 1, 1)), ("a", "stale", dt.datetime(2023, 1, 1))],
        "source string, source_url string, posted_at timestamp",
    )
    out = scratch_path(spark, "new")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    job_streams.stream_dedupe(stream, store, out, scratch_path(spark, "p"), NOW).awaitTermination()
    assert sorted(r.arrival for r in tables.read_store(spark, out).collect()) == [1, 3, 5, 7, 8, 9]


def test_stream_dedupe_calls_state_once_a_bucket(spark, tmp_path, monkeypatch):
    from vacanta.streaming import state

    monkeypatch.setattr(state, "BUCKETS", 2)  # so all keys meet others
    at, stale = "2024-01-15T00:00:00Z", "2023-01-01T00:00:00Z"
    row = lambda i, s, u, t=at: {"arrival": i, "source": s, "source_url": u, "posted_at": t}
    rest = [row(100 + i, "a", f"v{i}") for i in range(300)]
    folder = write_files(
        tmp_path / "in",
        [[row(2, "a", "x"), row(1, "a", "x"), row(3, None, "1:a:x"), row(4, "1", "a:x"), row(5, None, None), row(6, None, ""),
          row(7, "a", "s", stale), row(8, "a", "old"), *rest],
         [row(9, "a", "x"), row(10, None, "1:a:x"), row(11, "1", "a:x"), row(12, None, None), row(13, "a", "s"), *rest]],
    )
    store = spark.createDataFrame(
        [("a", "old", dt.datetime(2024, 1, 1)), ("a", "v7", dt.datetime(2024, 1, 1))],
        "source string, source_url string, posted_at timestamp",
    )
    schema = struct(arrival=LONG, source=TEXT, source_url=TEXT, posted_at=TIME)
    out = scratch_path(spark, "new")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    job_streams.stream_dedupe(stream, store, out, scratch_path(spark, "p"), NOW).awaitTermination()
    got = sorted(r.arrival for r in tables.read_store(spark, out).collect())
    assert got == sorted([1, 3, 4, 5, 6, 7, 12, 13, *(100 + i for i in range(300) if i != 7)])

    class Known:
        kept, calls = [], 0

        def getListState(self, *args, **kwargs):
            return self

        def get(self):
            self.calls += 1
            return list(self.kept)

        def appendValue(self, value):
            self.calls += 1
            self.kept.append(value)

    known, bucket = Known(), state._FirstSeen(60, "arrival")
    bucket.init(known)
    frame = state.pd.DataFrame(
        {"arrival": range(500), "key_text": [f"k{i % 250}" for i in range(500)], "key_kept": True, "key_bucket": 0}
    )
    for most, left in ((2, 250), (3, 0)):  # one look and, if there are new keys, one addition
        assert sum(map(len, bucket.handleInputRows((0,), iter([frame[:300], frame[300:]]), None))) == left
        assert known.calls == most


def test_watermark_dedupe(spark, tmp_path):
    schema = struct(arrival=LONG, source=TEXT, source_url=TEXT, posted_at=TIME)
    row = lambda i, u: {"arrival": i, "source": "a", "source_url": u, "posted_at": "2024-01-15T00:00:00Z"}
    folder = write_files(tmp_path / "in", [[row(1, "u1"), row(2, "u2")], [row(3, "u1"), row(4, "u3")]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    out = scratch_path(spark, "out")
    query = (
        job_streams.dedupe_within_watermark(stream).writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "p")).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    assert sorted(r.source_url for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u3"]


# --- essays ----------------------------------------------------------------------------------


def change(op, i, at, **more):
    return {"op": op, "id": i, "changed_at": f"2024-01-01T00:00:{at:02d}Z", **more}


def make_fussy_model():
    def model(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    return model


def make_broken_model():
    raise RuntimeError("no model")


CHANGES = [
    [change("create", 1, 1, question="What is Spark?", answer="An engine", keywords=["mine"]),
     change("create", 2, 2, answer="poison answer"), change("create", 3, 3),
     change("update", 77, 4, answer="unknown", supplied=["answer"])],
    [change("update", 1, 5, answer="A fast engine", supplied=["answer"]),
     change("update", 1, 6, question=None, supplied=["question"]),
     change("create", 4, 7, answer="short lived"), change("delete", 4, 8)],
]


def run_essays(spark, folder, make_model, dim=2):
    out, bad = scratch_path(spark, "essays"), scratch_path(spark, "bad")
    stream = spark.readStream.schema(ESSAY_CHANGE).option("maxFilesPerTrigger", 1).json(folder)
    essay_streams.enrich_essays(stream, out, bad, scratch_path(spark, "p"), dim, make_model).awaitTermination()
    return out, bad


def test_enrich_essays(spark, tmp_path):
    out, bad = run_essays(spark, write_files(tmp_path / "in", CHANGES), make_fussy_model)
    got = {r.id: r for r in essay_streams.current_essays(spark, out).collect()}
    assert set(got) == {1, 2}
    assert (got[1].question, got[1].answer) == (None, "A fast engine")
    assert got[1].keywords == ["engine", "spark"]  # made on create, kept by the update
    assert got[1].embedding == [float(len("A fast engine engine spark")), 1.0]
    assert got[2].embedding is None and got[2].answer == "poison answer"
    refused = sorted((r.id, r.op) for r in tables.read_store(spark, bad).collect())
    assert refused == [(2, "embed"), (3, "write")]


def test_keywords_do_not_depend_on_the_batches(spark, tmp_path):
    texts = ["red apples and pears", "red cherries", "green pears, red plums", "plums plums figs", "figs", "old red text"]
    changes = [change("create", i + 1, i, question=None, answer=t) for i, t in enumerate(texts)]
    changes += [
        change("update", 2, 10, keywords=["given"], supplied=["keywords"]),
        change("create", 6, 11, answer="new green text"),
        change("delete", 4, 12),
        change("update", 3, 13, answer="other words", supplied=["answer"]),
    ]
    found = []
    for k, groups in enumerate(([changes], [[c] for c in changes], [changes[:7], changes[7:]])):
        out, _ = run_essays(spark, write_files(tmp_path / f"in{k}", groups), make_fussy_model)
        found.append({r.id: r.keywords for r in essay_streams.current_essays(spark, out).collect()})
    assert found[0] == found[1] == found[2]
    assert set(found[0]) == {1, 2, 3, 5, 6} and found[0][2] == ["given"]
    # "red" is in three live texts, "green" and "pears" in two: rarer words come first
    assert found[0][3] == ["plums", "green", "pears", "red"] and found[0][6] == ["new", "text", "green"]


def test_broken_model_blocks_nothing(spark, tmp_path):
    out, bad = run_essays(spark, write_files(tmp_path / "in", CHANGES[:1]), make_broken_model)
    got = {r.id: r.embedding for r in essay_streams.current_essays(spark, out).collect()}
    assert got == {1: None, 2: None}
    assert {(r.id, r.op) for r in tables.read_store(spark, bad).collect()} == {
        (1, "enrich"), (2, "enrich"), (3, "write"),
    }


def test_index_follows_writes(spark, tmp_path):
    ddl = essay_streams.STORED_ESSAY
    row = lambda i, text, at, deleted=False: (i, None, text, None, None, None, dt.datetime(2024, 1, at), deleted)
    inbox = str(tmp_path / "in")
    args = [scratch_path(spark, n) for n in ("postings", "indexed", "p")]
    for rows in ([row(1, "red apples", 1), row(2, "green pears", 1)], [row(1, "blue plums", 2), row(2, "x", 2, True)]):
        spark.createDataFrame(rows, ddl).write.mode("append").parquet(inbox)
        essay_streams.index_on_write(spark.readStream.schema(ddl).parquet(inbox), *args).awaitTermination()
    index = essay_streams.current_postings(spark, *args[:2])
    assert {(r.id, r.term) for r in index.collect()} == {(1, "blue"), (1, "plum")}
    asked = spark.createDataFrame([(0, "plums")], "query_id bigint, text string")
    assert [r.id for r in search.search_postings(index, asked, 5).collect()] == [1]


def test_envelopes_without_sequence_lose_nothing(spark, tmp_path):
    groups = [[{k: v for k, v in message(0, [job(1), job(2)]).items() if k != "sequence"}],
              [{k: v for k, v in message(0, [job(3), job(4)]).items() if k != "sequence"}]]
    path = write_files(tmp_path / "in", groups)
    jobs, errors = postings.explode_envelopes(postings.read_envelopes(spark, path))
    rows = jobs.orderBy("arrival").collect()
    assert sorted(r.job_id for r in rows) == [1, 2, 3, 4] and [r.arrival for r in rows] == [1, 2, 3, 4]
    assert errors.count() == 0


def test_arrival_without_sequence_goes_by_file_name(spark, tmp_path):
    def bare(jobs):
        return {k: v for k, v in message(0, jobs).items() if k != "sequence"}

    groups = [[bare([job(1)])], [bare([job(k, description="long " * 500) for k in (2, 3)]), bare([job(4)])], [bare([job(5)])]]
    jobs, _ = postings.explode_envelopes(postings.read_envelopes(spark, write_files(tmp_path / "in", groups)))
    assert [r.job_id for r in jobs.orderBy("arrival").collect()] == [1, 2, 3, 4, 5]
    assert "source_file" not in jobs.columns


def test_jobs_behind_the_completion_message_are_stored(spark, tmp_path):
    groups = [[message(2, [], is_complete=True)], [message(1, [job(2)])], [message(0, [job(1)])]]
    path = write_files(tmp_path / "in", groups)
    out = target(spark)
    job_streams.stream_jobs(
        job_streams.envelope_stream(spark, path, files_per_batch=1), "r1", out, cv_table(spark),
        RunSettings(now="2024-01-20 00:00:00", dim=16), user_id=lambda: F.lit(0).cast("bigint"),
    )
    assert {r.external_id for r in tables.read_store(spark, out.store).collect()} == {"1", "2"}


def test_creates_without_an_id_are_refused_in_the_open(spark, tmp_path):
    change = {**CHANGES[0][0], "id": None}
    out, bad = run_essays(spark, write_files(tmp_path / "in", [[change]]), make_fussy_model)
    assert essay_streams.current_essays(spark, out).count() == 0
    assert [r.reason for r in tables.read_store(spark, bad).collect()] == ["a positive id is required"]
