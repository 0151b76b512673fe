"""Document comparison: pairs of texts, by line or paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import align
from vellum.functions.spans import let
from vellum.functions.text import fold_case, strip


def units(text: Column, mode: str = "line") -> Column:
    """Lines (the last one may be empty), or paragraphs; a text with one paragraph at most falls back to its lines that aren't blank."""
    lines = F.split(text, "\n", -1)
    if mode == "line":
        return lines
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n+", -1), strip), lambda p: p != "")
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.filter(lines, lambda x: x.rlike(r"(?U)\S")))


def normal_unit(unit: Column, ignore_whitespace: bool = True, ignore_case: bool = False) -> Column:
    out = strip(F.regexp_replace(unit, r"(?U)\s+", " ")) if ignore_whitespace else unit
    return fold_case(out) if ignore_case else out


#: Fixed value: what words, marks and white space are cut into.
TOKEN = r"(?U)\s+|\w+|[^\w\s]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def compare(
    pairs: DataFrame, original: str = "original", revised: str = "revised", mode: str = "line", ignore_whitespace: bool = True, ignore_case: bool = False
) -> DataFrame:
    """``pairs`` with similarity, identical, counts, changes and a diff with all lines. Narrow, in built-in functions; null texts are empty.

    Units are matched as module align has it, similarity is twice the matched units by all units. A change has the number that it has among
    changes and equal runs, its lines (from 1, null where a side has none), both texts, and for modified ones the segments of words.
    """
    first, second = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(revised), F.lit(""))
    keys = lambda u: F.transform(u, lambda x: normal_unit(x, ignore_whitespace, ignore_case))
    rows = pairs.select("*", units(first, mode).alias("_a"), units(second, mode).alias("_b"))
    pair = F.struct(keys(F.col("_a")).alias("a"), keys(F.col("_b")).alias("b"))
    rows = align.match_each(rows.withColumn("_p", F.array(pair)), "_p", "_m").withColumn("_m", F.get("_m", F.lit(0)))
    rows = rows.withColumn("_g", align.changes(F.col("_a"), F.col("_b"), F.col("_m")))
    block = lambda side, lo, hi: F.array_join(F.slice(side, lo + 1, hi - lo), "\n")
    both = F.transform("_g", lambda g: F.struct(block(F.col("_a"), g.i1, g.i2).alias("original"), block(F.col("_b"), g.j1, g.j2).alias("revised")))
    rows = rows.withColumn("_t", both)
    rows = rows.withColumn("_w", F.transform("_t", lambda t: F.struct(tokens(t.original).alias("a"), tokens(t.revised).alias("b"))))
    rows = align.match_each(rows, "_w", "_x").withColumn("_y", F.zip_with("_w", "_x", lambda w, x: align.changes(w.a, w.b, x)))
    rows = rows.withColumn("_s", F.zip_with("_w", "_y", lambda w, y: align.segments(w.a, w.b, y)))
    a, b, gaps = F.col("_a"), F.col("_b"), F.col("_g")
    some_a, some_b = lambda g: g.i1 < g.i2, lambda g: g.j1 < g.j2
    total = lambda kind, size: F.aggregate(F.filter(gaps, kind), F.lit(0).cast("long"), lambda acc, g: acc + size(g))
    begins_equal = F.get(gaps, F.lit(0))["i1"] + F.get(gaps, F.lit(0))["j1"] > 0

    def change(g: Column, k: Column) -> Column:
        both = some_a(g) & some_b(g)
        return F.struct(
            (2 * k + F.when(begins_equal, 2).otherwise(1)).cast("int").alias("id"),
            F.when(both, "modified").when(some_a(g), "removed").otherwise("added").alias("type"),
            F.when(some_a(g), g.i1 + 1).alias("original_start"),
            F.when(some_a(g), g.i2).alias("original_end"),
            F.when(some_b(g), g.j1 + 1).alias("revised_start"),
            F.when(some_b(g), g.j2).alias("revised_end"),
            F.get("_t", k)["original"].alias("original"),
            F.get("_t", k)["revised"].alias("revised"),
            F.when(both, F.get("_s", k)).otherwise(F.array().cast("array<struct<type:string,text:string>>")).alias("inline"),
        )

    def lines(s: Column) -> Column:
        """Each line of the diff with its mark: equal ones as the revised text has them."""
        marked = lambda side, lo, hi, mark: F.transform(F.slice(side, lo + 1, hi - lo), lambda x: F.concat(F.lit(mark), x))
        before = lambda k: F.when(k > 0, F.get(s, k - 1)["j2"]).otherwise(0)
        parts = F.transform(s, lambda g, k: F.concat(marked(b, before(k), g.j1, " "), marked(a, g.i1, g.i2, "-"), marked(b, g.j1, g.j2, "+")))
        rest = F.get(s, F.size(s) - 1)["j2"]
        return F.when(F.size(s) > 0, F.array_join(F.concat(F.array(F.lit("--- original"), F.lit("+++ revised")), F.flatten(parts), marked(b, rest, F.size(b), " ")), "\n")).otherwise("")

    n = F.size("_a") + F.size("_b")
    return rows.select(
        *pairs.columns,
        F.when(n > 0, F.round(2 * F.size("_m") / n, 6)).otherwise(1.0).alias("similarity"),
        (F.size(gaps) == 0).alias("identical"),
        total(lambda g: ~some_a(g), lambda g: g.j2 - g.j1).alias("added"),
        total(lambda g: ~some_b(g), lambda g: g.i2 - g.i1).alias("removed"),
        total(lambda g: some_a(g) & some_b(g), lambda g: F.greatest(g.i2 - g.i1, g.j2 - g.j1)).alias("modified"),
        F.size("_m").cast("long").alias("unchanged"),
        F.transform(gaps, change).alias("changes"),
        let(gaps, lines).alias("unified_diff"),
    )


def line_overlap(left: DataFrame, right: DataFrame, key: str, text: str = "text", **normal) -> DataFrame:
    """key, common, only_left, only_right: units counted as multisets, natively and without a pairwise matcher."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        unit = normal_unit(F.col("u"), **normal)
        return df.select(key, F.explode(units(F.col(text))).alias("u")).groupBy(key, unit.alias("unit")).agg(F.count(F.lit(1)).alias(name))

    joined = counted(left, "l").join(counted(right, "r"), [key, "unit"], "full")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))  # noqa: E741
    return joined.groupBy(key).agg(
        F.sum(F.least(l, r)).alias("common"), F.sum(F.greatest(l - r, F.lit(0))).alias("only_left"), F.sum(F.greatest(r - l, F.lit(0))).alias("only_right")
    )
