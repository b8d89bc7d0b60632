"""Held-out folds, bounded samples of labelled rows, names of columns made on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold,
                      F.lit(False))


def bounded_ids(rows: DataFrame, bound: int, salt: str) -> DataFrame:
    """At most ``bound`` rows in the order of a salted hash of ``doc_id`` (a distributed top-k)."""
    return rows.orderBy(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), "doc_id").limit(bound)


def free_prefix(df: DataFrame, prefix: str = "_v") -> str:
    """A prefix that no column of the table begins with, whatever the case; for columns made on the way."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` by their exact names, dots included."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in like.columns])


def positional(df: DataFrame) -> DataFrame:
    """The table with columns ``c0, c1, ...``, for steps that cannot take every name (dots, own columns)."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])
