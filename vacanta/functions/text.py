"""Text expressions: trimming, tokens, light English analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

TOKEN = r"[\p{L}\p{N}]+"

# English function words that carry no search meaning.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been before but by can could did "
    "do does for from had has have he her him his how i if in into is it its me more most my no "
    "not of on or our out over she should so some such than that the their them then there these "
    "they this those to under up us was we were what when where which while who why will with "
    "would you your"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it.

    The lambda binds the value, so the optimizer cannot copy its expression into every use
    when it moves a filter below the projection.
    """
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column | str) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    """NULL for empty text; the text itself otherwise."""
    return F.nullif(col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def singular(term: Column | str) -> Column:
    """Light plural stripping: -ies becomes -y, a final -s (not -ss) is dropped."""
    t = col(term)
    size = F.length(t)
    return (
        F.when((size > 4) & t.endswith("ies"), F.concat(t.substr(F.lit(1), size - 3), F.lit("y")))
        .when((size > 3) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), size - 1))
        .otherwise(t)
    )


def is_stop_word(term: Column | str) -> Column:
    return col(term).isin(STOP_WORDS)
