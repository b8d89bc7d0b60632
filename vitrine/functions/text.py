"""Split long text into ordered parts of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.schemas import TEXT_CHUNK_CHARS


def text_chunks(df: DataFrame, text_col: str, size: int = TEXT_CHUNK_CHARS,
                part_col: str = "parte", chunk_col: str = "texto") -> DataFrame:
    """One row per part of at most ``size`` characters, in order; empty text gives none.

    Parts are cut at character (code point) positions, like slicing a Python
    string. Each row is exploded where it lies: no shuffle. One pass of a regular
    expression cuts the parts, so the work per row is proportional to its length.
    """
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0))
    other = [c for c in df.columns if c != text_col]
    return df.select(*other, F.posexplode(parts).alias(part_col, chunk_col))
