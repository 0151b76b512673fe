"""How filters interact: a Walsh-Hadamard audit of n filters (at most 6) over all orders.

Each row has a mask, a bit for each filter that it fails. For each part, and each label within it, 2^n signed sums are taken,
one for each subset s of the filters: the sum over the rows of (-1)^(number of filters of s that the row fails). These are
the Walsh-Hadamard transform of the counts by mask, so the same transform and a division by 2^n, which leaves no remainder, give
the counts back. All n! orders follow from 2^n counts: no row is looked at again. Summed over all orders, a filter removes a
row that fails it, and k filters in all, in n!/k of them: that is its Shapley value times n!, in closed form.

A row fails the filter of repeats if the same text stands at any smaller id. Rows are first counted by
text digest, part, labels and id, then by text, so copies of one text are summed before they meet; the least id is brought
back to a text's counts, of which there is one for each part and label.

Edge cases: null texts are empty, and empty ones repeat each other. Null parts count as the empty string. Rows without an
id aren't smaller than any and repeat none. Rows with one id and text don't repeat each other. A row of labels without an id is left
out; of several labels for an id any that says 1 counts. Empty tables give no rows. Columns of other names aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import WORD_BREAKS, Scratch

_SIGNS = r"[#$%&*|]"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8: under 50 words; under 65 % distinct words; over 5 % of A-Z; one of #$%&*|."""
    words = F.filter(F.split(text, f"[{WORD_BREAKS}]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, _LETTERS, ""))
    return (
        F.when(F.size(words) < 50, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"), 2).otherwise(0)
        + F.when(100 * upper.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(_SIGNS), 8).otherwise(0)
    )


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, good, toxic, mask, n): how many rows of ``docs`` have these labels and fail these filters, in several rows each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"),
        text_failures(text).alias("mask"),
    )
    told = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    no = F.lit(False)
    joined = rows.join(told, "id", "left").select("id", "part", "same", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    kind = ["same", "mask", "part", "good", "toxic"]
    by_id = joined.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
    )
    by_text = Scratch(docs.sparkSession, "audit").write(by_text, "by_text")  # read twice; the texts are read once
    least = by_text.groupBy("same").agg(F.min("first.id").alias("least"), F.count(F.lit(1)).alias("kinds"))
    # Texts of one kind have their least id at hand; only the others are joined with it.
    shared = least.where("kinds > 1").select(F.col("same").alias("text"), "least")
    met = by_text.join(shared, F.col("same") == F.col("text"), "left")
    new = F.when(F.col("first.id") == F.coalesce("least", "first.id"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = F.array(F.struct(F.col("mask"), new.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - new).alias("n")))
    return met.select("part", "good", "toxic", F.explode(split).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")


def _sign(mask: Column | int, subset: Column | int) -> Column:
    """-1 where an odd number of the subset's filters fail."""
    both = mask.bitwiseAND(subset) if isinstance(mask, Column) else subset.bitwiseAND(mask)
    return 1 - 2 * (F.bit_count(both) % 2)


def cells(rows: DataFrame, labels: list[str], filters: int) -> DataFrame:
    """(part, all, *labels): arrays of the counts by mask, from signed parity sums of (part, mask, n) that are inverted."""
    if not 1 <= filters <= 6:
        raise ValueError("one to six filters")
    size = 2**filters
    sums = []
    for label in ["all", *labels]:
        n = F.col("n") if label == "all" else F.when(F.col(label), F.col("n")).otherwise(0)
        sums += [F.sum(n * _sign(F.col("mask"), F.lit(s))).alias(f"{label}_{s}") for s in range(size)]
    signed = rows.groupBy("part").agg(*sums)

    def back(label: str) -> Column:
        w = F.array(*[f"{label}_{s}" for s in range(size)])
        count = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda acc, s: acc + F.get(w, s) * _sign(s, m))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: (count(m) / size).cast("long")).alias(label)

    return signed.select("part", *[back(label) for label in ["all", *labels]])


def orders(found: DataFrame, names: str, labels: list[str]) -> DataFrame:
    """A row for each part, order of the filters ``names`` (a letter each) and step, from the counts of cells()."""
    size, total = 2 ** len(names), factorial(len(names))
    every = F.explode(F.lit(["".join(p) for p in permutations(names)]))
    rows = found.withColumn("filter_order", every).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    bit = lambda upto: sum((F.when(F.instr(upto, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))
    rows = rows.withColumn("own", bit(F.expr("substring(filter_order, step, 1)"))).withColumn("prior", bit(F.expr("substring(filter_order, 1, step - 1)")))

    def over(counts: str, where, times=lambda m: F.lit(1)) -> Column:
        add = lambda acc, m: acc + F.when(where(m), F.get(F.col(counts), m) * times(m)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), add)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("prior")) != 0
    here = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        over("all", here).alias("removed"),
        over("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        over("all", lambda m: m == F.col("own")).alias("unique_fails"),
        *[over(label, here).alias(f"{label}_lost") for label in labels],
        over("all", fails, lambda m: (F.lit(total) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters ABCDE over ``docs``: see the module and text_failures(); E is the filter of repeats."""
    return orders(cells(masks(docs, labels, id_col, text_col, part_col), ["good", "toxic"], 5), "ABCDE", ["good", "toxic"])
