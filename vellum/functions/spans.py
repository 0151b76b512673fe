"""Spans of regular-expression matches, without a UDF.

A text is split at the matches; the lengths of the pieces and of the matches give every match's place.
Offsets are 0-based, half-open, in characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda function evaluates what it refers to for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sum of what stands before each element of an array of whole numbers.

    Goes by blocks of about the square root of the length, since a fold copies what it has gathered at every step.
    """
    none = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))

    def fold(values: Column, number) -> Column:
        return F.aggregate(
            values,
            none,
            lambda acc, x: F.struct((acc["total"] + number(x)).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")),
        )

    def joined(blocks: Column) -> Column:
        starts = fold(blocks, lambda b: b["total"])["before"]
        return F.flatten(F.zip_with(starts, blocks, lambda at, b: F.transform(b["before"], lambda x: x + at)))

    def blocks(pair: Column) -> Column:
        a, wide = pair["a"], pair["wide"]
        at = F.sequence(F.lit(1), F.size(a), wide)
        return let(F.transform(at, lambda i: fold(F.slice(a, i, wide), lambda x: x)), joined)

    wide = F.ceil(F.sqrt(F.size(numbers))).cast("int")
    return F.when(F.size(numbers) > 0, let(F.struct(numbers.alias("a"), wide.alias("wide")), blocks)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, value) of the non-overlapping matches of a Java pattern that matches no empty string."""

    def place(pair: Column) -> Column:
        found, pieces = pair.found, pair.pieces
        lengths = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.char_length(m) + F.char_length(p))
        ends = F.zip_with(running_sums(lengths), lengths, lambda at, n: at + n)
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("value")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(both, place)).otherwise(none)


def greedy(spans: Column) -> Column:
    """Spans (start, rank, longest, end, ...) without overlaps: by start, then rank, then length, first come first kept.

    ``spans``: array of structs whose first fields are start, minus priority, minus length, end.
    """
    empty = F.struct(F.lit(0).alias("last"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["last"]
        return F.struct(
            F.when(fits, s["end"]).otherwise(acc["last"]).alias("last"),
            (acc["i"] + 1).alias("i"),
            F.when(fits, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"),
        )

    def kept(ordered: Column) -> Column:
        return F.transform(F.aggregate(ordered, empty, step, lambda acc: acc["kept"]), lambda i: F.get(ordered, i))

    return let(F.array_sort(spans), kept)


def typed(found: Column, kind: str, priority: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m.start.alias("start"),
            F.lit(-priority).alias("rank"),
            (m.start - m.end).alias("longest"),
            m.end.alias("end"),
            F.lit(kind).alias("type"),
            m.value.alias("value"),
        ),
    )


def replace_spans(text: Column, spans: Column, with_) -> Column:
    """``text`` with each of its disjoint, ordered spans replaced by ``with_(span)``."""

    def joined(pair: Column) -> Column:
        whole, at = pair["text"], pair["spans"]
        before = lambda i: F.when(i > 0, F.get(at, i - 1)["end"]).otherwise(0)
        marked = F.transform(at, lambda s, i: F.concat(F.substring(whole, before(i) + 1, s["start"] - before(i)), with_(s)))
        rest = F.substr(whole, before(F.size(at)) + 1)
        return F.array_join(F.concat(marked, F.array(rest)), "")

    return F.when(text.isNotNull(), let(F.struct(text.alias("text"), spans.alias("spans")), joined))
