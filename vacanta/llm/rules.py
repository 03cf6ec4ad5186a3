"""Quality rules as a ledger of bitmasks; DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit k says
that rule k failed. What a document's fate is comes later, from a policy: a named and versioned set of rules, those that
reject alone and those of which it may fail a few. Policies and ablations (what would stay without one
rule) are bit operations on that integer, so no text is read again for them.

A window of five words that occurs twice in a text has equal 64-bit hashes at both places. Texts
without equal hashes have no repeated window; the windows of the others are compared word by word.

Defined cases: a null, empty or blank text has no words, all measurements 0, and fails ``few_words`` alone. Repeated rows
are judged each on their own; texts of any length are read whole; an empty table gives an empty ledger. Other
columns are kept; columns with the names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_digits", "longest_word",
)

#: Name and failure condition; the position is the bit. New rules go at the end, so that stored ledgers stay readable.
#: The conditions are plain SQL over the measurements, for any engine.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("many_digits", "5 * n_digits > word_chars"),
    ("giant_word", "longest_word > 1000"),
)
BITS = {name: k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document stays if no rule of ``always`` failed and at most ``allowed`` rules of ``counted``."""

    name: str
    version: int
    always: tuple[str, ...]
    counted: tuple[str, ...] = ()
    allowed: int = 0

    @staticmethod
    def mask(rules: Iterable[str]) -> int:
        return sum(1 << BITS[r] for r in rules)

    def keeps(self, failed: Column) -> Column:
        hard = failed.bitwiseAND(F.lit(self.mask(self.always)))
        soft = failed.bitwiseAND(F.lit(self.mask(self.counted)))
        return (hard == 0) & (F.bit_count(soft) <= self.allowed)


BASE = Policy("base", 1, always=("few_words", "repeated_windows"))
STANDARD = Policy(
    "standard", 1,
    always=(*BASE.always, "symbols", "few_letters", "giant_word"),
    counted=("duplicate_lines", "short_words", "long_words", "many_digits"),
    allowed=1,
)
POLICIES = (BASE, STANDARD)


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, so that lambdas read a value instead of computing it."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _only(text: Column, others: str) -> Column:
    """How many characters are left without the runs ``others`` matches."""
    return F.length(F.regexp_replace(text, others, ""))


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _covered(places: Column) -> Column:
    """How many words the windows that start at the ascending ``places`` cover."""
    reach = F.transform(
        places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))
    )
    return F.aggregate(reach, F.lit(0).cast("bigint"), lambda n, k: n + k)


def _equal_neighbours(ordered: Column, key: str) -> Column:
    """Ascending places of the entries of a sorted array whose ``key`` a neighbour has as well."""
    twice = F.filter(
        ordered, lambda x, i: (F.get(ordered, i - 1)[key] == x[key]) | (F.get(ordered, i + 1)[key] == x[key])
    )
    return F.array_sort(F.transform(twice, lambda x: x["at"]))


def _with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: the words in windows that occur more than once in the row's array ``words``."""
    codes, windows, ordered, places = _free(df, "_codes", "_windows", "_ordered", "_places")
    df = _fixed(df, **{codes: F.transform(words, lambda w: F.xxhash64(w))})
    whole = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - (WINDOW - 1), F.lit(0)))
    hashed = F.transform(whole, lambda x, i: F.xxhash64(x, *[F.get(codes, i + k) for k in range(1, WINDOW)]))
    df = _fixed(df, **{windows: hashed}).drop(codes)
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    by_hash = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
    df = _fixed(df, **{ordered: F.when(some, by_hash)}).drop(windows)
    df = _fixed(df, **{places: _equal_neighbours(F.col(ordered), "hash")}).drop(ordered)
    # only windows of equal hashes are compared word by word; words hold no space, so the joined text is the window
    spelt = F.transform(
        places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("window"), i.alias("at"))
    )
    df = _fixed(df, **{ordered: F.array_sort(spelt)}).drop(places)
    df = _fixed(df, **{places: _equal_neighbours(F.col(ordered), "window")}).drop(ordered)
    return _fixed(df, **{out: F.coalesce(_covered(F.col(places)), F.lit(0)).cast("bigint")}).drop(places)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements, all bigint."""
    plain = [c for c in docs.columns if c not in MEASURES]
    words, bare, lines, repeats = _free(docs, "_words", "_bare", "_filled_lines", "_repeats")
    given = F.coalesce(F.col(text), F.lit(""))
    split = F.array_remove(F.split(given, f"{_SPACE}+", -1), "")
    filled = F.filter(F.split(given, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = _fixed(docs, **{words: split, bare: F.regexp_replace(given, f"{_SPACE}+", ""), lines: filled})
    df = _with_repeats(df, words, repeats)
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(bare),
        "n_symbols": _only(F.col(bare), f"[^{SYMBOLS}]+"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.col(repeats),
        "n_lines": F.size(lines),
        "n_letters": _only(F.col(bare), r"\P{L}+"),
        "n_digits": _only(F.col(bare), "[^0-9]+"),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)),
    }
    return df.select(*plain, *[c.cast("bigint").alias(name) for name, c in found.items()])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``failed``: bit k is set if rule k failed."""
    bits = F.lit(0).cast("bigint")
    for k, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, text).withColumn("failed", bits)


def applied(rows: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Add ``out``: whether ``policy`` keeps the row of a ledger."""
    return rows.withColumn(out, policy.keeps(F.col("failed")))


def ablations(rows: DataFrame, policies: Iterable[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: rows that fail it, that the policy rejects, and that only this rule keeps out.

    Rows are counted per value of ``failed`` first, so that what follows has at most 2 ^ rules rows.
    """
    counted = rows.groupBy("failed").agg(F.count("*").alias("n"))
    parts = []
    for policy in policies:
        for rule in (*policy.always, *policy.counted):
            bit = F.lit(1 << BITS[rule])
            fails = F.col("failed").bitwiseAND(bit) != 0
            without = F.col("failed").bitwiseAND(F.bitwise_not(bit.cast("bigint")))
            rejected = ~policy.keeps(F.col("failed"))
            parts.append(
                counted.agg(
                    F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.sum(F.when(rejected, F.col("n"))), F.lit(0)).alias("n_rejected"),
                    F.coalesce(
                        F.sum(F.when(rejected & policy.keeps(without), F.col("n"))), F.lit(0)
                    ).alias("n_rejected_by_it_alone"),
                ).select(
                    F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"),
                    F.lit(rule).alias("rule"), "*",
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def oracle(policy: Policy = STANDARD, base: Policy = BASE) -> str:
    """SQL for the ledger of ``documents`` and what ``policy`` makes of it."""
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS bare
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split WHERE len(words) >= {WINDOW})
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM repeated) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, len(words) AS n_words, length(bare) AS word_chars,
         length(bare) - length(regexp_replace(bare, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(bare, '\\P{{L}}+', '', 'g')) AS n_letters,
         length(bare) - length(regexp_replace(bare, '[0-9]', '', 'g')) AS n_digits,
         coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word
  FROM split s LEFT JOIN covered c USING (doc_id)
), ledger AS (SELECT *, {bits} AS failed FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed & {base.mask(base.always)} <> 0 AS base_failed,
       failed & {policy.mask(policy.always)} = 0
         AND bit_count(CAST(failed & {policy.mask(policy.counted)} AS BIGINT)) <= {policy.allowed} AS kept,
       CAST(failed AS BIGINT) AS failed
FROM ledger
"""


ORACLE = oracle()
