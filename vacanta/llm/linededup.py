"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A rolling hash over the hashes of ``WINDOW`` consecutive lines ends a chunk where it is divisible by
``DIVISOR``, so an inserted or removed line moves only the boundaries near it. A chunk of two or more
lines, not all blank, that occurs more than once in the whole table stays at its first place (smallest id, then
place in the text) and is removed everywhere else. Chunks meet by their 128-bit digest; their bytes
are then compared, and a digest whose chunks are not all equal is left in place.

Narrow rows (digests) decide; the texts are shuffled once, by row, to meet the decisions, and written
once. ``remove_runs`` takes no chunks: it removes every run of lines that occurred before, to both of its ends;
the pipeline uses it, while ``remove_repeated`` keeps to the chunks its SQL defines. Defined cases: a null text stays null; empty texts and single lines are never changed; rows that
repeat both id and text are one document; null ids sort first. Other columns are kept; columns with
the names of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import written

WINDOW = 2
DIVISOR = 3
#: A repeated line of more words than this is a run by itself.
LONG_LINE = 50
_FACTOR = 31


def line_code(line: Column) -> Column:
    """32 bits of the line's md5 as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, so that lambdas read a value instead of computing it."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_chunks(df: DataFrame, text: str) -> DataFrame:
    """Add ``_lines`` and the first and last line of every chunk (``_starts``, ``_ends``)."""
    lines = F.split(F.col(text), "\n", -1)
    df = _fixed(df, _lines=lines, _codes=F.transform(lines, line_code))
    earlier = [F.col("_codes")]
    for k in range(1, WINDOW):
        pad = F.array_repeat(F.lit(0).cast("bigint"), k)
        earlier.append(F.slice(F.concat(pad, "_codes"), F.lit(1), F.size("_codes")))
    rolled = F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(earlier)])

    def boundary(z: Column, i: Column) -> Column:
        rolling = sum((z[f"c{k}"] * (_FACTOR**k) for k in range(1, WINDOW)), z["c0"])
        ends = (rolling % DIVISOR == 0) | (i + 1 == F.size("_codes"))
        return F.when(ends, i + 1)

    df = _fixed(df, _ends=F.filter(F.transform(rolled, boundary), lambda e: e.isNotNull()))
    after = F.transform(F.slice("_ends", F.lit(1), F.size("_ends") - 1), lambda e: e + 1)
    return _fixed(df.drop("_codes"), _starts=F.concat(F.array(F.lit(1)), after))


def chunk_text(k: Column) -> Column:
    """Text of chunk ``k`` (from 0) of a row made by ``with_chunks``."""
    start, end = F.get("_starts", k), F.get("_ends", k)
    return F.array_join(F.slice("_lines", start, end - start + 1), "\n")


def _numbers() -> Column:
    return F.sequence(F.lit(0), F.size("_ends") - 1)


def repeated_chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(_row, _found)``: per row its chunks whose digest occurs more than once."""
    chunks = with_chunks(docs.where(F.col(text).contains("\n")), text).select(
        "_row",
        F.col(doc_id).alias("id"),
        F.explode(
            F.filter(
                F.transform(
                    _numbers(),
                    lambda k: F.struct(
                        k.alias("chunk"),
                        F.when(
                            F.get("_ends", k) > F.get("_starts", k), chunk_text(k)
                        ).alias("text"),
                    ),
                ),
                lambda c: c["text"].rlike("\\S"),
            )
        ).alias("c"),
    )
    chunks = chunks.select(
        "_row", F.unhex(F.md5("c.text")).alias("digest"),
        F.struct("id", "_row", F.col("c.chunk").alias("chunk")).alias("place"),
    )
    shared = cut(  # written, so that the join below can split a hot digest
        chunks.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("place").alias("first"))
        .where("n > 1")
    )
    return (
        chunks.join(shared, "digest")
        .groupBy("_row")
        .agg(
            F.collect_set(  # at most one entry per chunk of the row
                F.struct(
                    F.col("place.chunk").alias("chunk"), "digest",
                    (F.col("place") == F.col("first")).alias("is_first"),
                )
            ).alias("_found")
        )
    )


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``kept_text`` and ``lines_removed`` to every row."""
    results = ("kept_text", "lines_removed")
    columns = [c for c in docs.columns if c not in results]
    docs = docs.select(*columns).withColumn("_row", _row(doc_id, text))
    met = written(docs.join(repeated_chunks(docs, doc_id, text), "_row", "left"), "linededup")

    # byte comparison: digests with more than one text behind them
    compared = with_chunks(met.where("_found IS NOT NULL"), text).select(
        F.explode(
            F.transform(
                "_found",
                lambda f: F.struct(f["digest"].alias("digest"), chunk_text(f["chunk"]).alias("text")),
            )
        ).alias("c")
    )
    unequal = (
        compared.groupBy("c.digest", "c.text").agg(F.lit(1).alias("one"))
        .groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    )
    blocked = written(
        met.where("_found IS NOT NULL")
        .select("_row", F.explode("_found.digest").alias("digest"))
        .join(unequal, "digest", "left_semi")
        .groupBy("_row").agg(F.collect_set("digest").alias("_blocked")),
        "unequal",
    )
    met = met.join(blocked, "_row", "left")

    removed = F.transform(
        F.filter(
            "_found",
            lambda f: ~f["is_first"]
            & ~F.coalesce(F.array_contains(F.col("_blocked"), f["digest"]), F.lit(False)),
        ),
        lambda f: f["chunk"],
    )
    met = _fixed(met, _removed=F.coalesce(removed, F.array().cast("array<int>")))
    changed = F.size("_removed") > 0
    same = met.where(~changed).select(
        *columns, F.col(text).alias("kept_text"), F.lit(0).cast("bigint").alias("lines_removed")
    )
    cut_rows = _fixed(
        with_chunks(met.where(changed), text), _kept=F.array_except(_numbers(), F.col("_removed"))
    )
    lines = F.aggregate(
        "_removed", F.lit(0).cast("bigint"),
        lambda n, k: n + F.get("_ends", k) - F.get("_starts", k) + 1,
    )
    return same.unionByName(
        cut_rows.select(
            *columns,
            F.array_join(F.transform("_kept", chunk_text), "\n").alias("kept_text"),
            lines.alias("lines_removed"),
        )
    )


def _row(doc_id: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.col(text))))


def with_windows(df: DataFrame, text: str) -> DataFrame:
    """Add ``_lines`` and ``_windows``: ``(first, last, key)`` of all neighbours among the lines that are not
    blank, and of every line of more than ``LONG_LINE`` words; ``key`` is the md5 of each of its lines."""
    df = _fixed(df, _lines=F.split(F.col(text), "\n", -1))
    marks = F.transform(
        "_lines",
        lambda line, i: F.struct(
            i.alias("at"),
            F.when(line.rlike("\\S"), F.unhex(F.md5(line))).alias("code"),
            (F.size(F.split(F.trim(line), "\\s+")) > LONG_LINE).alias("long"),
        ),
    )
    df = _fixed(df, _marks=F.filter(marks, lambda m: m["code"].isNotNull()))

    def window(first: Column, last: Column, key: Column) -> Column:
        return F.struct(first["at"].alias("first"), last["at"].alias("last"), key.alias("key"))

    pairs = F.transform(
        "_marks",
        lambda m, k: window(m, F.get("_marks", k + 1), F.concat(m["code"], F.get("_marks", k + 1)["code"])),
    )
    alone = F.transform(F.filter("_marks", lambda m: m["long"]), lambda m: window(m, m, m["code"]))
    windows = F.concat(F.filter(pairs, lambda w: w["last"].isNotNull()), alone)
    return _fixed(df, _windows=windows).drop("_marks")


def repeated_windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(_row, _found)``: per row its windows whose key occurs more than once."""
    windows = with_windows(docs.where(F.col(text).isNotNull()), text).select(
        "_row", F.col(doc_id).alias("id"), F.explode("_windows").alias("w")
    ).select(
        F.col("w.key").alias("key"),
        F.struct("id", "_row", F.col("w.first").alias("first")).alias("place"),
        F.col("w.last").alias("last"),
    )
    shared = cut(  # written, so that the join below can split a hot key
        windows.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("earliest")).where("n > 1")
    )
    return (
        windows.join(shared, "key")
        .groupBy(F.col("place._row").alias("_row"))
        .agg(
            F.collect_set(  # at most two entries per line of the row
                F.struct(
                    F.col("place.first").alias("first"), "last", "key",
                    (F.col("place") == F.col("earliest")).alias("is_first"),
                )
            ).alias("_found")
        )
    )


def remove_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``kept_text`` and ``lines_removed``: runs of lines seen before are gone.

    A run is two or more neighbouring lines that are not blank, or one line of more than ``LONG_LINE`` words. All
    its windows of two lines are repeated as well, and their union is the whole run, so nothing depends on where
    a passage begins or ends; blank lines inside a run go with it. A window stays at its first place; what
    is removed always has an equal line at an earlier place, so one copy of every line is kept.
    """
    results = ("kept_text", "lines_removed")
    columns = [c for c in docs.columns if c not in results]
    docs = docs.select(*columns).withColumn("_row", _row(doc_id, text))
    met = written(docs.join(repeated_windows(docs, doc_id, text), "_row", "left"), "linededup")

    # byte comparison: line digests with more than one text behind them
    ends = F.array_distinct(F.flatten(F.transform("_found", lambda f: F.array(f["first"], f["last"]))))
    compared = (
        _fixed(met.where("_found IS NOT NULL"), _lines=F.split(F.col(text), "\n", -1))
        .select(F.explode(F.transform(ends, lambda k: F.get("_lines", k))).alias("line"))
        .select(F.unhex(F.md5("line")).alias("code"), "line")
    )
    unequal = (
        compared.groupBy("code", "line").agg(F.lit(1).alias("one"))
        .groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    )
    codes = F.array_distinct(
        F.flatten(F.transform("_found.key", lambda k: F.array(F.substring(k, 1, 16), F.substring(k, -16, 16))))
    )
    blocked = written(
        met.where("_found IS NOT NULL").select("_row", F.explode(codes).alias("code"))
        .join(unequal, "code", "left_semi")
        .groupBy("_row").agg(F.collect_set("code").alias("_blocked")),
        "unequal",
    )
    met = met.join(blocked, "_row", "left")

    def safe(key: Column) -> Column:
        halves = F.array(F.substring(key, 1, 16), F.substring(key, -16, 16))
        return ~F.coalesce(F.arrays_overlap("_blocked", halves), F.lit(False))

    gone = F.filter("_found", lambda f: ~f["is_first"] & safe(f["key"]))
    lines = F.array_distinct(F.flatten(F.transform(gone, lambda f: F.sequence(f["first"], f["last"]))))
    met = _fixed(met, _removed=F.coalesce(lines, F.array().cast("array<int>")))
    changed = F.size("_removed") > 0
    same = met.where(~changed).select(
        *columns, F.col(text).alias("kept_text"), F.lit(0).cast("bigint").alias("lines_removed")
    )
    cut_rows = _fixed(met.where(changed), _lines=F.split(F.col(text), "\n", -1))
    cut_rows = _fixed(
        cut_rows, _kept=F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    )
    return same.unionByName(
        cut_rows.select(
            *columns,
            F.array_join(F.transform("_kept", lambda k: F.get("_lines", k)), "\n").alias("kept_text"),
            F.size("_removed").cast("bigint").alias("lines_removed"),
        )
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), codes AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS code FROM lines
), marked AS (
  SELECT *, CASE WHEN (code + {_FACTOR} * coalesce(lag(code) OVER w, 0)) % {DIVISOR} = 0
                   OR i = max(i) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS ends
  FROM codes WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS chunk FROM marked
), chunks AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS chunk_text, count(*) AS n
  FROM numbered GROUP BY doc_id, chunk
), placed AS (
  SELECT *, n > 1 AND regexp_matches(chunk_text, '\\S') AND
            row_number() OVER (PARTITION BY chunk_text ORDER BY doc_id, chunk) > 1 AS removed
  FROM chunks
), kept AS (
  SELECT doc_id,
         coalesce(string_agg(chunk_text, chr(10) ORDER BY chunk) FILTER (WHERE NOT removed), '') AS kept_text,
         CAST(coalesce(sum(n) FILTER (WHERE removed), 0) AS BIGINT) AS lines_removed
  FROM placed GROUP BY doc_id
)
SELECT d.doc_id, k.kept_text, coalesce(k.lines_removed, 0) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
