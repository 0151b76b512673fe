"""Column builders for text: chunking, cleaning, casing, sentence splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the cleaner joins, keeps and folds.
HYPHEN_BREAK = r"-\s*\n\s*([a-zà-ÿ])"
SPECIAL = r"""(?U)[^\w\s.,;:!?()\[\]/%€$@'"-]"""
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def chunks(text: Column, size: int = 512, overlap: int = 100) -> Column:
    """Chunks of ``size`` characters, each ``overlap`` into the one before: array of (index, text, char_start, char_end).

    Offsets are 0-based and half-open. A blank or null text has no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    n = F.char_length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    made = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("index"),
            F.substring(text, i * step + 1, F.lit(size)).alias("text"),
            (i * step).alias("char_start"),
            F.least(i * step + size, n).alias("char_end"),
        ),
    )
    return F.when(~is_blank(text), made)


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, HYPHEN_BREAK, "$1")


def strip_special(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, "")


def collapse_space(text: Column) -> Column:
    """Blank-line runs become one, runs of spaces and tabs one space; each line and the whole are stripped."""
    out = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "[ \t]+", " ")
    return strip(F.array_join(F.transform(F.split(out, "\n", -1), strip), "\n"))


def title_case(text: Column) -> Column:
    """Every run of letters begins in upper case and goes on in lower case, so "it's" becomes "It'S"."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def casing(text: Column, how: str | None) -> Column:
    if how in (None, "", "none"):
        return text
    return {"lower": F.lower, "upper": F.upper, "title": title_case}[how](text)


def fold_case(text: Column) -> Column:
    """Lower case with the German sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold_digits(text: Column) -> Column:
    return F.translate(text, EASTERN_DIGITS, WESTERN_DIGITS)


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space."""
    return F.split(text, r"(?U)(?<=[.!?])\s+", -1)


def claims(text: Column) -> Column:
    """Sentences and lines, stripped, of over five characters."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda p: F.char_length(p) > 5)


def extension(path: Column) -> Column:
    """The lower-case suffix of a file name or URL path, with its dot; empty if there is none."""
    name = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
