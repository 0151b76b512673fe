"""Language detection by function words: scored by segment and averaged over the segments where a language appears.

Module language_model has the detector that is trained on labelled documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import let
from vellum.functions.text import strip

#: Function words of each language.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with by this be from at or an".split(),
    "fr": "le la les des et de un une du en est que qui dans pour par sur avec au elle il".split(),
    "de": "der die das und ist nicht mit den von zu ein eine für auf dem sich im des auch".split(),
    "es": "el la los de y en que es un una por con para del se las su al lo como".split(),
    "ar": "في من على إلى أن هذا هذه التي الذي مع عن كان لا ما".split(),
}


def segments(text: Column, mode: str = "document") -> Column:
    if mode == "paragraph":
        parts = F.split(text, "\n", -1)
    elif mode == "sentence":
        parts = F.split(text, r"(?U)(?<=[.!?])\s+", -1)
    else:
        parts = F.array(text)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


_LETTERS = "a-zà-ÿœ\u0600-\u06FF"


def scores(text: Column) -> Column:
    """array of (lang, hits, total): how many of the text's words each language's function words are, and all of them are.

    One scan for each language: a function word between characters that are no letters.
    """

    def by_language(lower: Column) -> Column:
        found = [(lang, rf"(?<![{_LETTERS}])(?:{'|'.join(own)})(?![{_LETTERS}])") for lang, own in STOP_WORDS.items()]
        return F.array(*[F.struct(F.lit(lang).alias("lang"), F.regexp_count(lower, F.lit(p)).alias("hits")) for lang, p in found])

    def totalled(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda acc, x: acc + x.hits)
        return F.transform(found, lambda x: F.struct(x.lang.alias("lang"), x.hits.alias("hits"), total.alias("total")))

    return let(let(F.lower(text), by_language), totalled)


def _ranked(docs: DataFrame, key: str, text: Column, mode: str, judge, worth, min_probability: float, max_languages: int) -> DataFrame:
    """One scan, all within the row: ``judge(text)`` is an array of (lang, p), in which only languages that show appear.

    Probabilities are averaged over the segments where a language shows; where none shows, the whole text is judged.
    """

    def averaged(found: Column) -> Column:
        flat = F.flatten(found)
        langs = F.array_distinct(F.transform(flat, lambda x: x.lang))

        def mean(lang: Column) -> Column:
            own = F.filter(flat, lambda x: x.lang == lang)
            return F.struct(lang.alias("lang"), F.round(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x.p) / F.size(own), 4).alias("probability"))

        means = F.filter(F.transform(langs, mean), lambda m: m.probability >= min_probability)
        order = lambda a, b: F.when(a.probability > b.probability, -1).when(a.probability < b.probability, 1).when(a.lang < b.lang, -1).otherwise(1)
        return F.slice(F.array_sort(means, order), 1, max_languages)

    def best(each: Column) -> Column:
        shown = F.exists(each, lambda found: F.size(found) > 0)
        return let(F.when(shown, each).otherwise(F.array(judge(text))), averaged)

    each = F.transform(F.filter(segments(text, mode), worth), judge)
    unknown = F.array(F.struct(F.lit("unknown").alias("lang"), F.lit(0.0).alias("probability")))
    rows = docs.select(key, let(each, best).alias("_best"))
    rows = rows.select(key, F.posexplode(F.when(F.size("_best") > 0, F.col("_best")).otherwise(unknown)).alias("i", "x"))
    return rows.select(key, "x.lang", "x.probability", (F.col("i") + 1).alias("rank"))


def detect_languages(
    docs: DataFrame, mode: str = "document", text_col: str = "text", key: str = "doc_id", min_probability: float = 0.1, max_languages: int = 5
) -> DataFrame:
    """key, lang, probability, rank by function words. Segments with under three ASCII letters don't count; where no segment shows a language, the
    whole text is judged, whatever its letters; a document without any language is "unknown" with probability 0. Ties go by language code."""

    def judge(text: Column) -> Column:
        return F.transform(F.filter(scores(text), lambda x: x.hits > 0), lambda x: F.struct(x.lang.alias("lang"), (x.hits / x.total).alias("p")))

    worth = lambda s: F.length(F.regexp_replace(s, "[^a-zA-Z]", "")) >= 3
    return _ranked(docs, key, F.coalesce(F.col(text_col), F.lit("")), mode, judge, worth, min_probability, max_languages)
