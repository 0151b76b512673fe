"""Text splitter: fixed-size chunks with overlap, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import chunks


def split_text(docs: DataFrame, text_col: str = "text", size: int = 512, overlap: int = 100) -> DataFrame:
    """A row for each chunk: the other columns of ``docs``, then index, text, char_start, char_end.

    Blank and null texts have no chunk. Narrow: no shuffle.
    """
    rest = [c for c in docs.columns if c != text_col]
    made = docs.select(*rest, F.explode(chunks(F.col(text_col), size, overlap)).alias("_c"))
    return made.select(*rest, "_c.*")
