"""Alignment of arrays of strings within a row, in built-in functions.

Patience: units that occur once on both sides are anchors where a longest increasing run of them keeps the order. Between anchors the same
is done once more with the units that occur once within the gap, and what is equal at both ends of a gap is matched too. Sorting
finds anchors in n log n; the longest run is a fold with a binary search, which copies its arrays of numbers where order is broken.
A gap without any anchor or equal end is one change, so this isn't always a longest common subsequence, but it's one in order.

Places count from 0; ranges are half-open. Null units are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import let

_PAIRS = "array<struct<i:int,j:int>>"
_INTS = "array<int>"


def _pair(i: Column, j: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def _common_once(a: Column, b: Column) -> Column:
    """(i, j) of units that occur once in each, by i."""
    tag = lambda side: lambda u, k: F.struct(u.alias("u"), F.lit(side).alias("side"), k.alias("k"))

    def pairs(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["u"].eqNullSafe(x.u) & (k >= 0) & (k < F.size(s)), F.lit(False))
        once = lambda x, k: (x.side == 0) & same(x, k + 1) & (F.get(s, k + 1)["side"] == 1) & ~same(x, k - 1) & ~same(x, k + 2)
        return F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(once(x, k), _pair(x.k, F.get(s, k + 1)["k"]))), lambda p: p.isNotNull()))

    return let(F.array_sort(F.concat(F.transform(a, tag(0)), F.transform(b, tag(1)))), pairs)


def _place(tails: Column, x: Column) -> Column:
    """How many of the ascending ``tails`` are under x."""
    size = F.size(tails)
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        up = (s["lo"] < s["hi"]) & F.coalesce(F.get(tails, half(s)) < x, F.lit(False))
        return F.struct(F.when(up, half(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(half(s)).alias("hi"))

    search = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(size))), F.struct(F.lit(0).alias("lo"), size.alias("hi")), step, lambda s: s["lo"])
    return F.when(size == 0, 0).when(F.get(tails, size - 1) < x, size).otherwise(search)


def longest_increasing(pairs: Column) -> Column:
    """A longest run of ``pairs``, which are in order of i, whose j increase."""

    def rank(acc: Column, p: Column) -> Column:
        def put(at: Column) -> Column:
            tails = F.concat(F.slice(acc["tails"], F.lit(1), at), F.array(p.j), F.slice(acc["tails"], at + 2, F.size(acc["tails"])))
            return F.struct(tails.alias("tails"), F.concat(acc["ranks"], F.array(at)).alias("ranks"))

        return let(_place(acc["tails"], p.j), put)

    def back(ps: Column) -> Column:
        ranks = F.aggregate(ps, F.struct(F.array().cast(_INTS).alias("tails"), F.array().cast(_INTS).alias("ranks")), rank, lambda acc: acc["ranks"])
        ranked = F.reverse(F.zip_with(ps, ranks, lambda p, r: F.struct(p.i.alias("i"), p.j.alias("j"), r.alias("r"))))

        def keep(rows: Column) -> Column:
            empty = F.struct(F.array_max(F.transform(rows, lambda x: x.r)).alias("want"), F.lit(2**31 - 1).alias("last"), F.lit(0).alias("k"), F.array().cast(_INTS).alias("kept"))

            def take(acc: Column, x: Column) -> Column:
                fits = (x.r == acc["want"]) & (x.j < acc["last"])
                return F.struct(
                    F.when(fits, acc["want"] - 1).otherwise(acc["want"]).alias("want"),
                    F.when(fits, x.j).otherwise(acc["last"]).alias("last"),
                    (acc["k"] + 1).alias("k"),
                    F.when(fits, F.concat(acc["kept"], F.array(acc["k"]))).otherwise(acc["kept"]).alias("kept"),
                )

            kept = F.aggregate(rows, empty, take, lambda acc: acc["kept"])
            return F.reverse(F.transform(kept, lambda k: _pair(F.get(rows, k)["i"], F.get(rows, k)["j"])))

        return let(ranked, keep)

    return F.when(F.size(pairs) > 0, let(pairs, back)).otherwise(F.array().cast(_PAIRS))


def _gaps(matched: Column, a: Column, b: Column) -> Column:
    """array of (i1, i2, j1, j2, last): what lies before each matched pair and behind the last one."""
    ended = F.concat(matched, F.array(_pair(F.size(a), F.size(b))))
    before = lambda e, k, f: F.when(k > 0, F.get(e, k - 1)[f] + 1).otherwise(0)
    return let(
        ended,
        lambda e: F.transform(
            e, lambda p, k: F.struct(before(e, k, "i").alias("i1"), p.i.alias("i2"), before(e, k, "j").alias("j1"), p.j.alias("j2"), (k == F.size(e) - 1).alias("last"))
        ),
    )


def _within(g: Column, inner: Column) -> Column:
    """A gap's matches, moved to their places, and the pair that ends the gap."""
    moved = F.transform(inner, lambda p: _pair(p.i + g.i1, p.j + g.j1))
    return F.concat(moved, F.when(g.last, F.array().cast(_PAIRS)).otherwise(F.array(_pair(g.i2, g.j2))))


def _ends(a: Column, b: Column) -> Column:
    """Matches at the beginning and at the end of two arrays."""
    short = F.least(F.size(a), F.size(b))
    run = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(x, F.lit(1), short), F.slice(y, F.lit(1), short), lambda u, v: u.eqNullSafe(v)), False), F.lit(0)) - 1, short).cast("int")
    span = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast(_INTS))

    def both(head: Column) -> Column:
        tail = F.least(run(F.reverse(a), F.reverse(b)), short - head)
        return let(tail, lambda t: F.concat(F.transform(span(F.lit(0), head), lambda k: _pair(k, k)), F.transform(span(F.lit(0), t), lambda k: _pair(F.size(a) - t + k, F.size(b) - t + k))))

    return let(run(a, b), both)


def match_each(df: DataFrame, pairs: str, out: str) -> DataFrame:
    """``df`` with ``out``: for each struct (a, b) of arrays in the array ``pairs``, the (i, j) of the units that are matched, both increasing. Narrow.

    Four steps, a column each: equal ends, anchors, anchors within gaps, equal ends within gaps.
    """

    def cut(side: Column, lo: Column, hi: Column) -> Column:
        return F.slice(side, lo + 1, hi - lo)

    def refined(p: Column, found: Column, how) -> Column:
        empty = lambda g: (g.i1 == g.i2) | (g.j1 == g.j2)
        inner = lambda g: F.when(~empty(g), how(cut(p.a, g.i1, g.i2), cut(p.b, g.j1, g.j2))).otherwise(F.array().cast(_PAIRS))
        return F.flatten(F.transform(_gaps(found, p.a, p.b), lambda g: _within(g, inner(g))))

    anchored = lambda a, b: longest_increasing(_common_once(a, b))
    now = df.withColumn(out, F.transform(pairs, lambda p: F.array().cast(_PAIRS)))
    for how in (_ends, anchored, anchored, _ends):
        now = now.withColumn(out, F.zip_with(F.col(pairs), F.col(out), _with(refined, how)))
    return now


def _with(refined, how):
    def step(p: Column, m: Column) -> Column:
        return refined(p, m, how)

    return step


def changes(a: Column, b: Column, matched: Column) -> Column:
    """array of (i1, i2, j1, j2), the ranges that aren't matched, in order."""
    return F.filter(_gaps(matched, a, b), lambda g: (g.i1 < g.i2) | (g.j1 < g.j2))


def segments(a: Column, b: Column, gaps: Column, separator: str = "") -> Column:
    """array of (type, text) from changes(): equal, removed and added parts; equal and removed ones make up ``a``, equal and added ones ``b``."""
    before = lambda k: F.when(k > 0, F.get(gaps, k - 1)["i2"]).otherwise(0)
    part = lambda kind, side, lo, hi: F.when(lo < hi, F.struct(F.lit(kind).alias("type"), F.array_join(F.slice(side, lo + 1, hi - lo), separator).alias("text")))
    each = F.transform(gaps, lambda g, k: F.array(part("equal", a, before(k), g.i1), part("removed", a, g.i1, g.i2), part("added", b, g.j1, g.j2)))
    rest = F.when(F.size(gaps) > 0, F.get(gaps, F.size(gaps) - 1)["i2"]).otherwise(0)
    return F.filter(F.concat(F.flatten(each), F.array(part("equal", a, rest, F.size(a)))), lambda p: p.isNotNull())
