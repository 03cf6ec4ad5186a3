"""Skill and keyword arrays, row by row and without a shuffle.

Skills are ``array<array<string>>``: the outer array is AND, an inner array lists alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip


def skills_1d_to_2d(c: Column | str) -> Column:
    """``[A, B]`` becomes ``[[A], [B]]``; empty or NULL becomes NULL."""
    c = col(c)
    return F.when(F.size(c) > 0, F.transform(c, lambda skill: F.array(skill)))


def skills_2d_to_1d(c: Column | str) -> Column:
    """Flatten the groups (alternatives are lost); empty or NULL becomes NULL."""
    flat = F.flatten(col(c))
    return F.when(F.size(flat) > 0, flat)


def format_skills(c: Column | str, max_skills: int = 10) -> Column:
    """Readable skills: ``A or B, C``, cut to ``max_skills`` single skills with the rest counted."""
    groups = F.filter(F.coalesce(col(c), F.array().cast("array<array<string>>")), _non_empty)
    start = F.struct(F.lit(0).alias("shown"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, group: Column) -> Column:
        room = F.lit(max_skills) - state["shown"]
        taken = F.least(F.size(group), room)
        part = F.array_join(F.slice(group, F.lit(1), F.greatest(taken, F.lit(0))), " or ")
        return F.when(
            taken > 0,
            F.struct(
                (state["shown"] + taken).alias("shown"),
                F.concat(state["parts"], F.array(part)).alias("parts"),
            ),
        ).otherwise(state)

    total = F.aggregate(groups, F.lit(0), lambda n, group: n + F.size(group))
    text = F.aggregate(groups, start, add, lambda state: F.array_join(state["parts"], ", "))
    return F.when(
        total > max_skills,
        F.concat(text, F.format_string(" ... and %d more", total - F.lit(max_skills))),
    ).otherwise(text)


def _non_empty(group: Column) -> Column:
    return F.size(group) > 0


def normalise_keywords(c: Column | str, limit: int = 10) -> Column:
    """Trimmed, non-blank, first casing of each case-insensitive keyword, at most ``limit``.

    ``limit`` is part of the feature; the accumulator never grows past it, so the cost per
    row stays linear in the number of raw keywords.
    """
    trimmed = F.filter(
        F.transform(F.coalesce(col(c), F.array().cast("array<string>")), strip),
        lambda word: word != "",
    )
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("seen"), empty.alias("kept"))

    def add(state: Column, word: Column) -> Column:
        skip = (F.size(state["kept"]) >= limit) | F.array_contains(state["seen"], F.lower(word))
        return F.when(skip, state).otherwise(
            F.struct(
                F.concat(state["seen"], F.array(F.lower(word))).alias("seen"),
                F.concat(state["kept"], F.array(word)).alias("kept"),
            )
        )

    return F.aggregate(trimmed, start, add, lambda state: state["kept"])


def counted(ordered: Column) -> Column:
    """``array<struct<term, tf>>`` of an ascending array, counted inside the row."""

    def runs(ordered: Column) -> Column:
        first = F.transform(
            ordered, lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i)
        )
        return let(
            F.filter(first, lambda i: i.isNotNull()),
            lambda starts: F.transform(
                starts,
                lambda s, k: F.struct(
                    F.get(ordered, s).alias("term"),
                    (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - s).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(ordered, runs)
