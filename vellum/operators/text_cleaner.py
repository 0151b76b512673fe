"""Text cleaner: hyphen breaks, special characters, dates, white space, casing, in this fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.date_normalizer import normalized_text


def clean_text(
    docs: DataFrame,
    text_col: str = "text",
    fix_hyphenation: bool = True,
    collapse_whitespace: bool = True,
    strip_special_chars: bool = False,
    normalize_casing: str | None = None,
    normalize_dates: bool = False,
    date_output_format: str = "YYYY-MM-DD",
) -> DataFrame:
    """``docs`` with cleaned_text, original_length, cleaned_length and chars_removed. Narrow."""
    out = F.col(text_col)
    if fix_hyphenation:
        out = tx.join_hyphens(out)
    if strip_special_chars:
        out = tx.strip_special(out)
    if normalize_dates:
        out = normalized_text(out, date_output_format)
    if collapse_whitespace:
        out = tx.collapse_space(out)
    out = tx.casing(out, normalize_casing)
    rows = docs.withColumn("cleaned_text", out)
    return rows.withColumns(
        {
            "original_length": F.char_length(text_col).cast("long"),
            "cleaned_length": F.char_length("cleaned_text").cast("long"),
            "chars_removed": (F.char_length(text_col) - F.char_length("cleaned_text")).cast("long"),
        }
    )
