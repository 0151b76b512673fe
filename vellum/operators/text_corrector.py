"""Spelling over relations: words near a dictionary word are corrected; two fragments of a known word are joined.

The dictionary is a relation of any size. Words go by their places: the words of all texts meet the corrections of the distinct
words by an equi-join, and what is found goes back to its text as a sorted list of (place, word). Adjacent fragments meet the dictionary
by what they make together. Texts are rebuilt from slices between those places, in linear time. Only keys, places and words are
dealt out for this. Before each of these joins a bitmap of the other side's hashes, 2^26 bits at most, goes to the words and leaves out most that
meet nothing; the joins decide, so a fuller bitmap only leaves out less. Texts are told apart by MD5, so equal texts are worked out alike.

Edge cases. A null text stays null, an empty one stays empty, both with 0 changes. Rows that are equal in every column stay as many.
An empty dictionary changes nothing. Terms are compared in lower case; of a term that is given more than once the greatest frequency counts. Extra columns
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.spans import let
from vellum.session import written

LETTERS = r"[A-Za-zÀ-ÿ]+"
TOKENS = r"[^ \t\n\x0B\f\r]+"
#: Bits of the bitmaps of hashes, which are broadcast as rows of 64 bits: 2^20 rows at most.
BITS = 1 << 26


def keep_case(word: Column, corrected: Column) -> Column:
    """``corrected`` in the case style of ``word``: all upper, first upper, or as it is."""
    upper = (word == F.upper(word)) & (F.char_length(word) > 1)
    first = F.substring(word, 1, 1)
    return F.when(upper, F.upper(corrected)).when(first == F.upper(first), F.concat(F.upper(F.substring(corrected, 1, 1)), F.substr(corrected, F.lit(2)))).otherwise(corrected)


def _likely(rows: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``values``, and some others, by a bitmap of hashes; ``rows`` aren't dealt out."""

    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c)), F.lit(BITS).cast("long"))

    def place(c: str) -> Column:
        return F.col(c).bitwiseAND(63).cast("int")

    made = values.select(bit(value).alias("_bit")).withColumn("_one", F.call_function("shiftleft", F.lit(1).cast("long"), place("_bit")))
    cells = made.groupBy(F.shiftright("_bit", 6).alias("_cell")).agg(F.bit_or("_one").alias("_ones"))
    found = rows.withColumn("_bit", bit(key)).join(F.broadcast(cells), F.shiftright("_bit", 6) == F.col("_cell"))
    return found.where(F.getbit("_ones", place("_bit")) == 1).drop("_bit", "_cell", "_ones")


def corrections(words: DataFrame, dictionary: DataFrame, word: str = "word", term: str = "term", frequency: str = "frequency", max_distance: int = 1) -> DataFrame:
    """word, corrected, distance for the distinct ``words`` that aren't terms but have one within ``max_distance``.

    Candidates share a deletion key (the word, or the word without one of its letters), so that words meet terms by an equi-join;
    the edit distance is verified. The nearest wins, then the most frequent, then the least. For distances over 1, keys with
    more letters deleted are made.
    """

    def keyed(df: DataFrame, col: str) -> DataFrame:
        keys = F.array(F.col(col))
        for _ in range(max_distance):
            keys = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.concat(F.array(k), _deletions(k)))))
        return df.withColumn("_key", F.explode(keys))

    lower = words.select(F.col(word).alias("_word")).distinct().withColumn("_w", F.lower("_word"))
    terms = dictionary.select(F.lower(term).alias("_t"), F.col(frequency).alias("_f"))
    unknown = lower.where(~((F.col("_word") == F.upper("_word")) & (F.char_length("_word") <= 4))).join(terms, F.col("_w") == F.col("_t"), "left_anti")
    keys = keyed(terms, "_t")
    pairs = _likely(keyed(unknown, "_w"), "_key", keys, "_key").join(keys, "_key").select("_word", "_w", "_t", "_f").distinct()
    near = pairs.withColumn("_d", F.levenshtein("_w", "_t")).where(F.col("_d") <= max_distance)
    best = near.groupBy("_word").agg(F.min(F.struct("_d", (-F.col("_f")).alias("f"), "_t")).alias("b"))
    return best.select(F.col("_word").alias(word), keep_case(F.col("_word"), F.col("b._t")).alias("corrected"), F.col("b._d").alias("distance"))


def _deletions(k: Column) -> Column:
    n = F.char_length(k)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substr(k, i + 1)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def _after(places: Column, i: Column) -> Column:
    """Where the ``i``-th segment begins: after the place before it."""
    return F.when(i == 0, 0).otherwise(F.get(places, i - 1) + 1)


def _rebuilt(text: Column, fixes: Column) -> Column:
    """``text`` with the words at the places of ``fixes`` (sorted: pos, corrected) replaced."""
    # Gaps before words, and the gap at the end, which has no word after it.
    parts = F.struct(F.split(text, LETTERS).alias("gaps"), F.regexp_extract_all(text, F.lit(LETTERS), 0).alias("words"), fixes.pos.alias("places"), fixes.corrected.alias("to"))

    def build(x: Column) -> Column:
        units = F.struct(F.zip_with(x.gaps, x.words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))).alias("units"), x.gaps.alias("gaps"), x.places.alias("places"), x.to.alias("to"))
        return let(units, joined)

    def joined(u: Column) -> Column:
        segments = F.transform(
            u.places, lambda p, i: F.concat(F.array_join(F.slice(u.units, _after(u.places, i) + 1, p - _after(u.places, i)), ""), F.get(u.gaps, p), F.get(u.to, i))
        )
        return F.concat(F.array_join(segments, ""), F.array_join(F.slice(u.units, F.element_at(u.places, -1) + 2, F.size(u.units)), ""))

    return let(parts, build)


def _joined(text: Column, places: Column) -> Column:
    """The tokens of ``text`` with one space between them, and none after the tokens at ``places`` (sorted)."""

    def build(x: Column) -> Column:
        segments = F.transform(x.places, lambda p, i: F.array_join(F.slice(x.tokens, _after(x.places, i) + 1, p + 1 - _after(x.places, i)), " "))
        return F.concat(F.array_join(segments, ""), F.array_join(F.slice(x.tokens, F.element_at(x.places, -1) + 2, F.size(x.tokens)), " "))

    return let(F.struct(F.regexp_extract_all(text, F.lit(TOKENS), 0).alias("tokens"), places.alias("places")), build)


def _merges(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(_k, _at): the places of tokens that are joined with the next: greedily from the left, no token twice."""
    two = let(F.regexp_extract_all("_text", F.lit(TOKENS), 0), lambda t: F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = texts.select("_k", F.posexplode(two).alias("pos", "p"))
    pairs = pairs.where("p.b IS NOT NULL").select("_k", "pos", F.lower("p.a").alias("a"), F.lower("p.b").alias("b"))
    # Terms are distinct; Spark would move a semi join to before the bitmap.
    whole = _likely(pairs.withColumn("t", F.concat("a", "b")), "t", known, "_t").join(known.select(F.col("_t").alias("t")), "t")
    first, second = known.select(F.col("_t").alias("a"), F.lit(True).alias("_a")), known.select(F.col("_t").alias("b"), F.lit(True).alias("_b"))
    open_ = whole.join(first, "a", "left").join(second, "b", "left").where("_a IS NULL OR _b IS NULL").select("_k", "pos").distinct()
    # Of adjacent pairs, which share a token, every other one is taken.
    run = open_.withColumn("_g", F.col("pos") - F.row_number().over(Window.partitionBy("_k").orderBy("pos")))
    taken = run.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_g").orderBy("pos"))).where("_n % 2 = 1")
    return taken.groupBy("_k").agg(F.array_sort(F.collect_list("pos")).alias("_at"))


def correct_text(
    docs: DataFrame, dictionary: DataFrame | Mapping[str, int], text_col: str = "text", max_distance: int = 1, term: str = "term", frequency: str = "frequency"
) -> DataFrame:
    """``docs`` with corrected_text, n_corrections, n_merges and their sum n_changes. ``dictionary``: a relation, or a small mapping.

    Words (letters) are corrected one by one, as ``corrections`` says; then, left to right, two adjacent tokens (by white space) are
    joined where one at least is unknown and both together are known. White space is kept unless something was joined: then
    it becomes single spaces.
    """
    if isinstance(dictionary, Mapping):
        dictionary = docs.sparkSession.createDataFrame([(str(k), int(n)) for k, n in dictionary.items()], f"`{term}` string, `{frequency}` long")
    terms = dictionary.groupBy(F.lower(F.col(f"`{term}`")).alias("_t")).agg(F.max(F.col(f"`{frequency}`")).alias("_f"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("_text")).withColumn("_k", F.unhex(F.md5("_text")))
    if max_distance > 0:
        words = rows.select("_k", F.posexplode(F.regexp_extract_all("_text", F.lit(LETTERS), 0)).alias("pos", "word"))
        better = written(corrections(words, terms, "word", "_t", "_f", max_distance).where("word <> corrected").select("word", "corrected"), "spelling")
        fixes = _likely(words, "word", better, "word").join(better, "word").groupBy("_k").agg(F.array_sort(F.collect_set(F.struct("pos", "corrected"))).alias("_fixes"))
        told = rows.join(fixes, "_k", "left")
        text = F.when(F.col("_fixes").isNull(), F.col("_text")).otherwise(_rebuilt(F.col("_text"), F.col("_fixes")))
        done = told.select("_row", text.alias("_text"), F.greatest(F.size("_fixes"), F.lit(0)).alias("n_corrections"))
        rows = written(done.withColumn("_k", F.unhex(F.md5("_text"))), "spelling")
    else:
        rows = rows.withColumn("n_corrections", F.lit(0))
    last = rows.join(_merges(rows, terms), "_k", "left")
    text = F.when(F.col("_at").isNull(), F.col("_text")).otherwise(_joined(F.col("_text"), F.col("_at")))
    merges = F.greatest(F.size("_at"), F.lit(0))
    made = {"corrected_text": text, "n_corrections": F.col("n_corrections"), "n_merges": merges, "n_changes": F.col("n_corrections") + merges}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return last.select(*kept, *[v.alias(k) for k, v in made.items()])
