"""Small helpers on columns shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have yet, in any letter case."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def in_holdout(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def let(value, body):
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]
