"""Joins of intervals that overlap, across relations, and the rectangles that word boxes under a span make up.

Intervals are half-open, [start, end), in whole numbers. An interval has a level, the least one whose bins (2^(bits + level) wide)
are as wide as it is, so it lies in two bins of its level at most. Two intervals meet at the higher one of their levels:
each goes to its bins there, the lower one as a guest. So an interval takes part in two rows for each level that the other side
has, however long it is, and a pair is told apart from others by keys, level and bin alone: equi-joins, which the adaptive
planner splits at hot bins, and no nested loop. A pair that shares two bins is reported in the first one. Both sides are dealt out:
how many bins an interval has isn't known from the size of what it is read from, nor how many words a text, so neither is broadcast by that.

Intervals with a null end, or that end before or where they start, overlap nothing. Rows with null keys have no partner. Columns of either
side that the other one has too, keys aside, aren't allowed, as in any join of Spark's that keeps names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import matches, running_sums


def _level(length: Column, bits: int) -> Column:
    over = F.shiftright(length - 1, bits)
    return F.when(over > 0, F.length(F.bin(over))).otherwise(0)


def _placed(rows: DataFrame, start: str, end: str, bits: int) -> DataFrame:
    valid = rows.where(F.col(start) < F.col(end))
    return valid.withColumn("_level", _level(F.col(end).cast("long") - F.col(start).cast("long"), bits))


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value.cast("long"), by.cast("int"))


def _binned(rows: DataFrame, start: str, end: str, bits: int, levels: list[int], own: bool) -> DataFrame:
    """A row for each bin: of the interval's own level, or of each higher one of ``levels``."""
    if own:
        at = rows.withColumn("_at", F.col("_level"))
    else:
        higher = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col("_level"))
        at = rows.withColumn("_at", F.explode(higher))
    by = F.col("_at") + bits
    bins = at.withColumn("_first", _shifted(F.col(start), by))
    return bins.withColumn("_bin", F.explode(F.sequence(F.col("_first"), _shifted(F.col(end) - 1, by)))).drop("_level")


def overlap_join(
    left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str] = ("start", "end"), right_range: tuple[str, str] = ("r_start", "r_end"), bits: int = 6
) -> DataFrame:
    """Pairs of rows that agree in ``on`` and whose intervals overlap: all columns of both, ``on`` once.

    ``bits``: the narrowest bins are 2^bits wide; results don't depend on it. The levels that occur (64 at most) are read
    beforehand, by an aggregation over the lengths.
    """
    a, b = _placed(left, *left_range, bits), _placed(right, *right_range, bits)
    levels = [sorted(r[0] for r in x.select("_level").distinct().collect()) for x in (a, b)]
    keys = [*on, "_at", "_bin"]

    def meet(left_own: bool, right_own: bool) -> DataFrame:
        x = _binned(a, *left_range, bits, levels[1], left_own).withColumnRenamed("_first", "_left_first")
        y = _binned(b, *right_range, bits, levels[0], right_own).withColumnRenamed("_first", "_right_first")
        met = x.hint("merge").join(y, keys)
        overlap = (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1]))
        return met.where(overlap & (F.col("_bin") == F.greatest("_left_first", "_right_first"))).drop("_at", "_bin", "_left_first", "_right_first")

    return meet(True, True).unionByName(meet(False, True)).unionByName(meet(True, False))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], key: list[str], **ranges) -> DataFrame:
    """Rows of ``left`` that overlap a row of ``right`` (semi-join); ``key`` names columns that tell left rows apart, without nulls."""
    slim = left.select(*dict.fromkeys([*on, *key, *ranges.get("left_range", ("start", "end"))]))
    return left.join(overlap_join(slim, right.select(*on, *ranges.get("right_range", ("r_start", "r_end"))), on, **ranges).select(*key).distinct(), key, "left_semi")


def not_overlapping(left: DataFrame, right: DataFrame, on: list[str], key: list[str], **ranges) -> DataFrame:
    """Rows of ``left`` that overlap no row of ``right`` (anti-join), those without a valid interval among them."""
    slim = left.select(*dict.fromkeys([*on, *key, *ranges.get("left_range", ("start", "end"))]))
    return left.join(overlap_join(slim, right.select(*on, *ranges.get("right_range", ("r_start", "r_end"))), on, **ranges).select(*key).distinct(), key, "left_anti")


def word_boxes(docs: DataFrame, key: str, text_col: str = "text", cell: tuple[float, float] = (6.0, 12.0), leading: float = 2.0) -> DataFrame:
    """(key, line, w_start, w_end, x0, y0, x1, y1): a box for each word of a text set in cells of one size. Narrow.

    ``leading`` is the room between lines. Places count in the whole text.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    wide, high = cell
    placed = docs.where(F.col(text_col).isNotNull()).select(key, lines.alias("_lines"))
    starts = running_sums(F.transform("_lines", lambda x: F.char_length(x) + 1))
    rows = placed.select(key, F.posexplode(F.arrays_zip(F.col("_lines").alias("text"), starts.alias("at"))).alias("line", "l"))
    words = rows.select(key, "line", F.col("l.at").alias("at"), F.explode(matches(F.col("l.text"), r"[^ \t\n\x0B\f\r]+")).alias("w"))
    return words.select(
        key,
        "line",
        (F.col("at") + F.col("w.start")).alias("w_start"),
        (F.col("at") + F.col("w.end")).alias("w_end"),
        (F.col("w.start") * wide).alias("x0"),
        (F.col("line") * high).alias("y0"),
        (F.col("w.end") * wide).alias("x1"),
        (F.col("line") * high + (high - leading)).alias("y1"),
    )


def span_rectangles(spans: DataFrame, boxes: DataFrame, key: str, by: list[str], pad: tuple[float, float] = (0.8, 0.4), bits: int = 6) -> DataFrame:
    """(*by, line, x0, y0, x1, y1, words): for each span and line, the rectangle around the boxes that the span touches, padded.

    ``spans``: (key, start, end) and the columns ``by`` that tell spans apart or bring them together: with ``by`` = [key], all
    spans of a document on one line share a rectangle. ``boxes``: as from word_boxes().
    """
    met = overlap_join(spans, boxes, [key], right_range=("w_start", "w_end"), bits=bits)
    return met.groupBy(*by, "line").agg(
        (F.min("x0") - pad[0]).alias("x0"),
        (F.min("y0") - pad[1]).alias("y0"),
        (F.max("x1") + pad[0]).alias("x1"),
        (F.max("y1") + pad[1]).alias("y1"),
        F.countDistinct("w_start").alias("words"),
    )
