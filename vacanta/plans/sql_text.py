"""SQL spellings of the text rules, for the oracles."""

from __future__ import annotations

from ..functions.text import STOP_WORDS, TOKEN, WHITESPACE

SPACES = "'" + WHITESPACE + "'"
STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}')"


def singular(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def cosine(a: str, b: str) -> str:
    return (
        f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    )
