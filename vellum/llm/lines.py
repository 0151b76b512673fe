"""Line dedup by winnowing over line hashes (operator 9). Built-in functions only.

A document is its sequence of lines that hold a word; blank lines take no part and stay. A run is
``min_run`` or more consecutive lines. Lines of a run that equals an earlier run (by id, then place) are deleted, same
document included; the first occurrence of everything stays. With ``alone`` given, a line of that many words or more counts as a
run by itself. What stays is then a repeat of a shorter line between other neighbours.

Method. In every window of ``min_run`` lines the least line hash is selected (the rightmost of equal ones), so that two
equal windows select the same line at the same place, and no run can hide: the selected lines are guaranteed fingerprints.
Only they become rows, each with the lines around it that lie in windows which selected it. Their positions are
joined with the fingerprints that occur more than once; a line that occurs once goes no further. From each position that is left
the match is extended both ways, line by line as far as those windows reach, and compared by the
lines' own 128-bit digests with the earliest position that has the same lines before and after it. What any later position
shares with an earlier one is deleted; longer runs are the union of the matches at the fingerprints in them.

Skew. A fingerprint or a match that a third of all rows share is counted before the shuffle, and joins back
to its rows through joins that the adaptive planner can split. Nothing is gathered by line.

Edge cases. Null texts stay null and have no lines; empty texts too have none. Rows with the same id and text
are one position, so none of them is a repeat of the other: all stay, and lose the same lines. Rows without an id come before all
others. A very long text is one row of line hashes, 28 bytes a line. Extra columns stay as they are, whatever their
names; only columns named like those that ``mark_repeated_lines`` adds are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, fresh, let, redealt, row_keys

#: A line counts if it has a character other than these.
_WORD = r"[^\x20\x09-\x0D]"
_BREAKS = r"[\x20\x09-\x0D]+"


def _hashed(docs: DataFrame, id_col: str, text_col: str, alone: int | None = None) -> DataFrame:
    """(id, row keys, and of the lines: place among all lines, hash, digest in hex, with ``alone`` whether it is that long)."""

    def more(s: Column) -> list[Column]:
        return [] if alone is None else [(F.size(F.filter(F.split(s.x, _BREAKS, -1), lambda w: w != "")) >= alone).alias("long")]

    key, key2 = row_keys(id_col, text_col)
    numbered = F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, i: F.struct(i.alias("p"), x.alias("x")))
    lines = F.filter(numbered, lambda s: s.x.rlike(_WORD))
    hashed = F.transform(lines, lambda s: F.struct(s.p.alias("p"), F.xxhash64(s.x).alias("h"), F.md5(s.x).alias("d"), *more(s)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), key2.alias("key2"), hashed.alias("l"))
    # A column of structs holds an array of each field.
    return rows.select("id", "key", "key2", *[F.col(f"l.{c}").alias(c) for c in ("p", "h", "d", *["long"] * (alone is not None))])


def _selected(hashed: DataFrame, w: int) -> DataFrame:
    """A row for each selected line: (id, row keys, its hash, places and digests of the lines around it, windows).

    ``around`` are the places of the lines in windows that selected it, ``digests`` theirs, 16 bytes each; there
    are ``n`` such windows, one after the other.
    """
    h = F.col("h")

    def least(at: Column) -> Column:
        """Where the window from ``at`` on selects: the least hash, the rightmost of equal ones."""
        if w > 3:
            return -F.array_min(F.transform(F.slice(h, at + 1, F.lit(w)), lambda x, k: F.struct(x.alias("h"), (-(at + k)).alias("p"))))["p"]
        best = at
        for k in range(1, w):
            best = F.when(F.get(h, at + k) <= F.get(h, best), at + k).otherwise(best)
        return best

    def runs(chosen: Column) -> Column:
        """The windows from, to that selected the same line: what a line was selected by stands together."""
        begins = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda i: (i == 0) | (F.get(chosen, i) != F.get(chosen, i - 1)))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(chosen, i).alias("s"), i.alias("lo"), (F.coalesce(F.get(b, k + 1), F.size(chosen)) - 1).alias("hi"))))

    n = F.size(h)
    chosen = F.sequence(F.lit(0), n - w) if w == 1 else F.transform(F.sequence(F.lit(0), n - w), least)
    rows = hashed.where(n >= w).select("id", "key", "key2", "p", "h", "d", F.explode(let(chosen, runs)).alias("r"))
    first, size = F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo") + w
    return rows.select(
        "id",
        "key",
        "key2",
        F.get(h, F.col("r.s")).alias("f"),
        F.slice("p", first, size).alias("around"),
        F.unhex(F.array_join(F.slice("d", first, size), "")).alias("digests"),
        (size - w + 1).alias("n"),
        F.lit(w).alias("w"),
    )


def repeated_lines(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """(row keys, places among all lines) of the repeats; rows without any are absent."""
    scratch = Scratch(docs.sparkSession, "lines")
    hashed = scratch.write(_hashed(docs, id_col, text_col, alone), "hashes")
    chosen = _selected(hashed, min_run)
    if alone is not None and min_run > 1:
        only = {c: F.filter(c, lambda x, i: F.get("long", i)) for c in ("p", "h", "d")}
        chosen = chosen.union(_selected(hashed.withColumns(only), 1))
    often = chosen.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    joined = chosen.join(redealt(often, "f", "g"), F.col("f") == F.col("g"))
    # Both ways from the fingerprint: each window that selected it, which is the lines before and after it that must match too.
    reach = joined.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    extended = reach.select(
        F.struct("id", "key", "key2", F.slice("around", F.col("k") + 1, F.col("w")).alias("places")).alias("place"),
        F.substring("digests", 16 * F.col("k") + 1, 16 * F.col("w")).alias("same"),
    ).withColumn("c", F.xxhash64("same"))
    first = extended.groupBy("c", "same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = redealt(first.select("c", F.col("same").alias("equal"), "first"), "c", "e")
    later = (F.col("c") == F.col("e")) & (F.col("same") == F.col("equal")) & (F.col("place") > F.col("first"))
    again = extended.join(first, later).select("place.key", "place.key2", F.explode("place.places").alias("p"))
    return again.groupBy("key", "key2").agg(F.collect_set("p").alias("dropped"))


def mark_repeated_lines(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """``docs`` with _kept (the lines that stay, blank ones included), _n_lines and _n_removed (both of lines with a word)."""
    docs = docs.drop("_kept", "_n_lines", "_n_removed")
    found = repeated_lines(docs, min_run, id_col, text_col, alone)
    key, key2, k, k2, dropped = fresh(docs, "key", "key2", "k", "k2", "dropped")
    found = redealt(found.select("key", F.col("key2").alias(k2), F.col("dropped").alias(dropped)), "key", k)
    keys = row_keys(id_col, text_col)
    rows = docs.withColumn(key, keys[0]).withColumn(key2, keys[1]).join(found, (F.col(key) == F.col(k)) & (F.col(key2) == F.col(k2)), "left")
    lines = F.coalesce(F.split(F.col(f"`{text_col}`"), "\n", -1), F.array().cast("array<string>"))

    def kept(all_lines):
        places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(dropped))
        return F.transform(places, lambda i: F.get(all_lines, i))

    return (
        rows.withColumn("_kept", F.when(F.col(dropped).isNull(), lines).otherwise(let(lines, kept)))
        .withColumn("_n_lines", F.size(F.filter(lines, lambda x: x.rlike(_WORD))).cast("long"))
        .withColumn("_n_removed", F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
        .drop(key, key2, k, k2, dropped)
    )


def drop_repeated_lines(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs deleted from the text; all rows and other columns stay. Null stays null."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    marked = mark_repeated_lines(docs.toDF(*names), min_run, at[id_col], at[text_col], alone)
    text = F.when(F.col(at[text_col]).isNotNull(), F.array_join("_kept", "\n"))
    return marked.withColumn(at[text_col], text).select(*names).toDF(*docs.columns)
