"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written as written

#: Long texts are handled in pieces of about this many characters, so memory stays bounded.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def word_pieces(text: str, size: int = PIECE, ends: str = " \n") -> Iterator[str]:
    """Cut a long text before one of ``ends`` (ASCII white space) that follows something other than white space.

    A run without such a place stays whole, and so do words that other white space is part of.
    """
    place = re.compile(f"(?<=\\S)[{ends}]")
    start = 0
    while len(text) - start > size:
        found = place.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text
