"""CV text: paragraph repair after extraction, and removal of personal data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, strip


def reflow_paragraphs(df: DataFrame, text: str, target: str = "reflowed") -> DataFrame:
    """Join the lines of broken text into paragraphs.

    A paragraph ends at a line that ends in ``.``, ``!`` or ``?`` when the next line starts
    with an upper-case letter. Each line picks the separator that follows it by looking one
    line ahead, so the work stays inside the row and needs no shuffle.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda line: line != "")

    def join_lines(parts: Column) -> Column:
        def with_separator(line: Column, i: Column) -> Column:
            following = F.get(parts, i + 1)
            new_paragraph = line.rlike(r"[.!?]$") & following.rlike(r"^\p{Lu}")
            return F.concat(
                line, F.when(following.isNull(), "").when(new_paragraph, "\n\n").otherwise(" ")
            )

        return F.array_join(F.transform(parts, with_separator), "")

    return df.withColumn(target, strip(F.regexp_replace(let(lines, join_lines), " +", " ")))


#: What may stand before a number or a cue word; it is put back.
_BEFORE = r"(^|[^\p{L}\p{N}])"

# Fixed values, applied in this order. Written without look-around so that any regular
# expression engine reads them alike. Phone numbers have a country code, an area code in
# brackets, groups of 3-3-4 or 3-3-2-2 digits, or ten digits and more in one run; grouped
# amounts and network addresses have none of these.
PII_PATTERNS: Mapping[str, str] = {
    "url": r"(?i)(?:https?://|www\.)[^\s<>\"']+|(?:linkedin\.com|github\.com)/[^\s<>\"']+",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "birth": r"(?i)" + _BEFORE + r"(?:(?:date of birth|birth date|born(?: on)?|dob)[ \t]*[:\-]?[ \t]*"
    r"[0-9]{1,4}(?:[./\-][0-9]{1,2}[./\-][0-9]{2,4})?|aged?[ \t]*[:\-]?[ \t]*[0-9]{1,3}\b)",
    "national_id": _BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": _BEFORE + r"(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){2,3}"
    r"|\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2})?"
    r"|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[ \-][0-9]{3}[ \-][0-9]{2}[ \-][0-9]{2}|\+?[0-9]{10,})\b",
}


#: Text without any of these (lower case) cannot match the pattern; a digit is ``None``.
PII_NEEDS: Mapping[str, tuple[str, ...] | None] = {
    "url": ("http", "www.", "linkedin.com/", "github.com/"),
    "email": ("@",),
    "birth": None,
    "national_id": None,
    "phone": None,
}


def bordered(pattern: str) -> bool:
    """Whether the first group of a pattern is what stands before the match."""
    return _BEFORE in pattern


def _may_match(name: str, text: Column) -> Column:
    """A scan for fixed strings, far cheaper than the pattern it spares."""
    if name not in PII_NEEDS:
        return F.lit(True)
    needs = PII_NEEDS[name]
    if needs is None:
        return F.translate(text, "0123456789", "") != text
    hit = F.lit(False)
    for part in needs:
        hit = hit | F.contains(F.lower(text), F.lit(part))
    return hit


def redact_pii(
    df: DataFrame,
    text: str,
    replacement: str = "",
    target: str = "clean",
    patterns: Mapping[str, str] = PII_PATTERNS,
) -> DataFrame:
    """Remove contact data, URLs, birth data and national ids; keep everything else.

    Adds ``target``, ``n_<class>`` per class and ``ok`` (false for blank input or output).
    Each class works on what the previous ones left, so one string is counted once. Personal
    names need a model: see :func:`redact_names`.
    """
    start = F.struct(F.coalesce(F.col(text), F.lit("")).alias("rest"))
    done: list[str] = []

    def remove(name: str, pattern: str):
        kept = "$1" if bordered(pattern) else ""

        def step(state: Column) -> Column:
            rest = state["rest"]
            found = F.regexp_count(rest, F.lit(pattern)).cast("bigint")
            count = F.when(_may_match(name, rest), found).otherwise(F.lit(0))
            return let(
                count,
                # only rows with a match are rewritten
                lambda n: F.struct(
                    F.when(n > 0, F.regexp_replace(rest, pattern, kept + replacement))
                    .otherwise(rest)
                    .alias("rest"),
                    *[state[c].alias(c) for c in done],
                    n.alias(f"n_{name}"),
                ),
            )

        return step

    state = start
    for name, pattern in patterns.items():
        state = let(state, remove(name, pattern))
        done.append(f"n_{name}")
    out = df.withColumn("_pii", state).withColumns({c: F.col("_pii")[c] for c in done})
    clean = strip(F.col("_pii")["rest"])
    return out.withColumns({target: clean, "ok": ~is_blank(text) & (clean != "")}).drop("_pii")


def redact_names(df: DataFrame, text: str, make_model) -> DataFrame:
    """Rewrite ``text`` by ``make_model()(list of texts)``, loaded once per Python worker.

    A model failure or blank output yields NULL text for that row, never a failed job.
    """

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def rewritten(values: list[str]) -> list[str | None]:
            try:
                return [(v or "").strip() or None for v in model(values)]
            except Exception:  # find the row that fails
                if len(values) == 1:
                    return [None]
                return [v for value in values for v in rewritten([value])]

        for frame in frames:
            out = frame[text].astype(object).where(frame[text].notna(), None)
            given = out.notna()
            if given.any():
                out[given] = pd.Series(rewritten(list(out[given])), index=out.index[given], dtype=object)
            yield frame.assign(**{text: out})

    return df.mapInPandas(rewrite, df.schema)
