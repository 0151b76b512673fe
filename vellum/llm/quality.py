"""Quality rules: hashed n-gram log-likelihood ratios (operator 2). Built-in functions only.

Two multinomials over hashed word n-grams (one and two words, ``BUCKETS`` buckets) are estimated:
one of trusted documents, smoothed towards the corpus, and one of the whole corpus, with add-one smoothing. A document's score is the sum, over its n-grams, of the log
ratio of the two, divided by the number of n-grams. Log ratios are rounded to millionths and summed as whole numbers,
so the verdict on a document does not depend on the order of anything: it is kept if score >= ``threshold``.

A trusted row is scored out of sample: its own n-grams are taken off the trusted side first, so that it is judged
as a row without a label would be. The threshold comes from these scores of the same fit, as ``limit_of`` says, since all
scores depend on how much text is trusted: the less, the more n-grams of good prose are unseen.

Both sides count every row of theirs: all documents, and all trusted ones. Trusted ids go out as bitmaps of ``RANGE`` neighbouring ids
each, so texts aren't dealt out; only where ids aren't whole numbers, or lie in more than ``MAX_RANGES`` such ranges, does Spark join by
id, and deal out both sides unless it finds the ids few enough to broadcast. The model is two arrays of ``BUCKETS`` numbers, written as one row and taken up by
scalar subqueries: as a constant it would be written out, for each use, in every text that Spark makes of the plan, which fills the driver's heap. The threshold's quantiles are exact, from counts of narrow cells of the score and the values in two to four of them.

Base rules come before the model: a document fails with fewer than ``min_words`` words, or if over half of its words stand
in windows of three words that its text has more than once. Words are runs of characters other than ASCII white space.

Edge cases. A null text has no words and fails. Documents without labels are scored like others. Without trusted rows
every ratio is 1 and the base rules alone decide; so they do with fewer than ``MIN_TRUSTED`` trusted rows past them.
Rows with the same id are judged each on its own; labels with the same id count once. A very long text is one row of word
hashes, 8 bytes a word. Extra columns stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from vellum.llm.common import WORD_BREAKS, Scratch, let

BUCKETS = 1 << 15
#: With fewer trusted rows past the base rules there is no threshold, and the base rules alone decide.
MIN_TRUSTED = 10
#: The threshold lies below the 1 % quantile of the trusted scores by this part of that quantile's distance from the median.
MARGIN = 1 / 3
SCALE = 1_000_000
#: Ids of one bitmap (4 KB), and bitmaps that are broadcast at most (16 MB).
RANGE, MAX_RANGES = 1 << 15, 1 << 12
#: Width of the cells (millionths of score) in which trusted rows are counted for quantiles.
CELL = 1_000
_BREAKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: The columns that judge() adds.
BASE = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")
VERDICT = ("_base_failed", "_score", "_kept")


def _words(text: str) -> Column:
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_BREAKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _BREAKS, -1))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(h: Column, n: int) -> Column:
    """Hashes of the windows of n words, from the words' hashes (an array that is at hand, as a column or by let())."""
    count = F.size(h) - n
    made = F.transform(F.sequence(F.lit(0), count), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    return F.when(count >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _buckets(h: Column, buckets: int) -> Column:
    return F.transform(F.concat(h, _grams(h, 2)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def _repeated(grams: Column, n: int) -> Column:
    """Words that lie in windows of n words whose hash occurs more than once in the array."""
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        def twice(s: Column, k: Column) -> Column:
            before, after = F.get(pairs, k - 1), F.get(pairs, k + 1)
            return F.coalesce(before.g == s.g, F.lit(False)) | F.coalesce(after.g == s.g, F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, twice), lambda s: s.i))

    seen = F.aggregate(
        let(ordered, starts),
        F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc.n + F.least(F.lit(n), s - acc["last"])).alias("n")),
    )
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), seen.n).otherwise(F.lit(0).cast("long"))


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _h (word hashes), _n_words, _word_chars, _n_symbols, _n_dup_lines and _n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("_h", _hashes(_words(text_col)))
    repeated = let(F.col("_h"), lambda h: let(_grams(h, 3), lambda g: _repeated(g, 3)))
    return rows.withColumns(
        {
            "_n_words": F.size("_h").cast("long"),
            "_word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
            "_n_symbols": F.regexp_count(text, F.lit(f"[{_SYMBOLS}]")).cast("long"),
            "_n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "_n_repeat_words": repeated,
        }
    )


def _ids(trusted: DataFrame, id_col: str) -> DataFrame:
    return trusted.select(F.col(id_col).alias("_t")).where("_t IS NOT NULL").distinct()


def _range(of: str) -> Column:
    return F.shiftright(F.col(of).cast("long"), RANGE.bit_length() - 1)


def _marks(ids: DataFrame, id_type: DataType) -> DataFrame:
    """The ids (_t), or, where they lie close together, a row for each range of theirs: _range and _bits."""
    if not all(isinstance(t, IntegralType) for t in (id_type, ids.schema["_t"].dataType)):
        return ids
    if ids.select(_range("_t")).distinct().count() > MAX_RANGES:
        return ids
    place = F.col("_t").cast("long").bitwiseAND(F.lit(RANGE - 1).cast("long"))
    return ids.groupBy(_range("_t").alias("_range")).agg(F.bitmap_construct_agg(place).alias("_bits"))


def _flagged(docs: DataFrame, marks: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with _trusted. ``marks``: the trusted ids (_t), or their bitmaps by _marks()."""
    if "_bits" not in marks.columns:
        return docs.join(marks, F.col(id_col) == F.col("_t"), "left").withColumn("_trusted", F.col("_t").isNotNull()).drop("_t")
    place = F.col(id_col).cast("long").bitwiseAND(F.lit(RANGE - 1).cast("long")).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, place.bitwiseAND(7))
    found = docs.join(F.broadcast(marks), _range(id_col) == F.col("_range"), "left")
    return found.withColumn("_trusted", F.coalesce(bit == 1, F.lit(False))).drop("_range", "_bits")


def _counts(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, buckets: int) -> dict[int, tuple[int, int]]:
    """Counts on the trusted side and in the corpus, by bucket. ``marks``: as for _flagged()."""
    bucketed = let(_hashes(_words(text_col)), lambda h: _buckets(h, buckets))
    rows = _flagged(docs.select(id_col, text_col), marks, id_col)
    grams = rows.select(F.col("_trusted").alias("t"), F.explode(bucketed).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count_if("t").alias("target"))
    # The table has ``buckets`` rows at most.
    return {r.b: (r.target, r.raw) for r in counts.collect()}


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Log ratios in millionths, by bucket. ``trusted``: the ids of trusted documents."""
    return log_ratios(_counts(docs, _ids(trusted, id_col), id_col, text_col, buckets), buckets)


def log_ratios(counts: dict[int, tuple[int, int]], buckets: int) -> list[int]:
    """The corpus with add-one smoothing; the trusted side with the corpus as its prior, of one count a bucket."""
    from math import log

    target, raw = (sum(c[k] for c in counts.values()) for k in (0, 1))
    out = []
    for b in range(buckets):
        t, r = counts.get(b, (0, 0))
        p = (r + 1) / (raw + buckets)
        out.append(round(SCALE * log((t + buckets * p) / ((target + buckets) * p))))
    return out


def _model(scratch: Scratch, counts: dict[int, tuple[int, int]], buckets: int) -> DataFrame:
    """A written row: _ratios, the log ratios by bucket, and _sums, the trusted side's counts with their prior."""
    raw = sum(c[1] for c in counts.values())
    found = (counts.get(b, (0, 0)) for b in range(buckets))
    sums = [t + buckets * (r + 1) / (raw + buckets) for t, r in found]
    made = F.from_json(F.lit(json.dumps({"_ratios": log_ratios(counts, buckets), "_sums": sums})), "_ratios array<bigint>, _sums array<double>")
    return scratch.write(scratch.spark.range(1).select(made.alias("m")).select("m.*"), "model")


def _own(sums: Column, of: int) -> Column:
    """What a trusted row's own n-grams (_b) add to its total: the total less this is that of a fit without the row. ``of``: the sum of all ``sums``."""

    def lost(run: Column, of: Column) -> Column:
        return run * F.round(-SCALE * F.log1p(-run / of)).cast("long")

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
        each = let(ends, lambda e: F.transform(e, lambda i, k: lost(i - F.coalesce(F.get(e, k - 1), F.lit(-1)), F.get(sums, F.get(s, i)))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)

    n = F.size("_b")
    return F.when(n == 0, 0).otherwise(let(F.sort_array("_b"), runs) - lost(n, F.lit(float(of))))


def _scored(docs: DataFrame, marks: DataFrame, model: DataFrame, target: int, min_words: int, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``docs`` with the base columns, _b, _base_failed, _total (of trusted rows: without their own counts) and _trusted. ``target``: n-grams of the trusted side."""
    rows = base_columns(_flagged(docs, marks, id_col), text_col).withColumn("_b", let(F.col("_h"), lambda h: _buckets(h, buckets)))
    # The optimizer puts the subqueries where they are used, so that no row carries them.
    rows = rows.withColumns({c: model.select(c).scalar() for c in model.columns})
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda acc, b: acc + F.get("_ratios", b))
    own = F.when(F.col("_trusted"), _own(F.col("_sums"), target + buckets)).otherwise(F.lit(0).cast("long"))
    failed = (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))
    return rows.select(*[c for c in rows.columns if c not in model.columns], (total - own).alias("_total"), failed.alias("_base_failed"))


def _quantiles(scores: DataFrame, shares: tuple[float, ...]) -> tuple[int, list[float]]:
    """How many values ``_score`` has, and its exact quantiles (linear between neighbours, as percentile()'s). No task holds all values."""
    cell = F.floor(F.col("_score") / CELL)
    cells = sorted((r.c, r.n) for r in scores.where("_score IS NOT NULL").groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(k for _, k in cells)
    if not n:
        return 0, []
    places = [share * (n - 1) for share in shares]
    ranks, found, before = {f(p) for p in places for f in (math.floor, math.ceil)}, {}, 0
    for c, k in cells:
        within = [r for r in ranks if before <= r < before + k]
        if within:
            at, values = before, scores.where(cell == F.lit(c)).groupBy("_score").agg(F.count(F.lit(1)).alias("n")).collect()
            for v in sorted(values, key=lambda r: r["_score"]):
                found |= {r: v["_score"] for r in within if at <= r < at + v.n}
                at += v.n
        before += k
    low, high = [found[math.floor(p)] for p in places], [found[math.ceil(p)] for p in places]
    return n, [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in zip(places, low, high, strict=True)]


def limit_of(scores: DataFrame) -> int | None:
    """The least score (millionths) that passes, from the scores (_score; nulls don't count) of all trusted rows out of sample; None if too few."""
    n, found = _quantiles(scores, (0.01, 0.5))
    if n < MIN_TRUSTED:
        return None
    low, mid = found
    return math.floor(low - MARGIN * (mid - low))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float | None = None,
    min_words: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (of it the columns ``keep``, or all) with the base columns, _score (millionths, mean), _base_failed and _kept.

    The threshold comes from the scores of trusted rows. With ``keep`` all rows are scored once, and the scores written, without
    text; else only the trusted rows are scored beforehand, so that no text is written. Columns named like those added are replaced.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {x.lower() for x in (*BASE, *VERDICT)}]
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*carried, id_col, text_col]))}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    ids = scratch.write(_ids(trusted, id_col), "trusted")
    marks = scratch.write(_marks(ids, docs.schema[id_col].dataType), "marks")
    counts = _counts(plain, marks, names[id_col], names[text_col], buckets)
    target = sum(t for t, _ in counts.values())
    rows = _scored(plain, marks, _model(scratch, counts, buckets), target, min_words, names[id_col], names[text_col], buckets)
    rows = rows.withColumn("_n", F.size("_b").cast("long"))
    rows = rows.select(*[names[c] for c in carried], *BASE, "_base_failed", "_total", "_n", "_trusted")
    if keep is not None:
        rows = scratch.write(rows, "scores")
    mean = F.col("_total") / F.greatest(F.col("_n"), F.lit(1))
    if threshold is None:
        limit = limit_of(scratch.write(rows.where("_trusted").select(F.when(~F.col("_base_failed"), mean).alias("_score")), "limits"))
    else:
        limit = round(threshold * SCALE)
    enough = F.lit(True) if limit is None else F.col("_total") >= F.lit(limit) * F.col("_n")
    out = rows.withColumn("_score", mean).withColumn("_kept", ~F.col("_base_failed") & enough)
    return out.select(*[F.col(names[c]).alias(c) for c in carried], *BASE, *VERDICT)
