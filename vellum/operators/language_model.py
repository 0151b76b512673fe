"""Languages by character n-grams: multinomials of 1-, 2- and 3-grams for each language, trained on labelled documents.

A text is lower-cased, what is no letter becomes one blank, and each n-gram falls into one of ``BUCKETS`` buckets by its code points.
Training counts buckets by language (one distributed count); the model holds whole numbers, 1000 ln((count + 1/2) / (total + BUCKETS / 2)), for
each language and bucket: 3 * BUCKETS numbers a language, whatever the corpus. Scoring looks each n-gram up in arrays that are part of the
plan and adds whole numbers, in built-in functions, so detection is one scan without a shuffle.

The probability of a language is its share of exp(score / 3000), 3 n-grams of a place counting as one. A text is known only if its
best language explains it about as well as it does its own training texts: its mean score has to reach the training
mean less ``SLACK`` less ``SIGMAS`` standard errors. Other languages and scripts are "unknown", then.

Edge cases: null and empty texts, and such without a letter, are unknown. Rows without a language don't train. Ties go by language code.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import let
from vellum.operators.language import _ranked

BUCKETS, BASE = 8191, 257
SLACK, SIGMAS = 300, 6


def ngrams(text: Column) -> Column:
    """The buckets of a text's n-grams: 1-grams in [0, BUCKETS), then 2-grams, then 3-grams."""

    def runs(c: Column) -> Column:
        n = F.size(c)
        two = F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: a * BASE + b)
        three = lambda pairs: F.zip_with(F.slice(pairs, F.lit(1), n - 2), F.slice(c, F.lit(3), n - 2), lambda a, b: a * BASE + b)
        at = lambda values, order: F.transform(values, lambda v: (v % BUCKETS + order * BUCKETS).cast("int"))
        return let(two, lambda pairs: F.concat(at(c, 0), at(pairs, 1), at(three(pairs), 2)))

    letters = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(" "))
    codes = F.transform(F.split(letters, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.when(text.rlike(r"\p{L}"), let(codes, runs)).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class LanguageModel:
    """Weights by language and bucket, and the mean and standard deviation of a language's own n-grams."""

    langs: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]

    def judge(self, text: Column) -> Column:
        """array of (lang, p): empty if the text is unknown; languages under a probability of 0.0001 don't show."""
        tables = [F.from_json(F.lit(json.dumps(w)), "array<int>") for w in self.weights]

        def total(grams: Column, table: Column) -> Column:
            return F.aggregate(grams, F.lit(0).cast("long"), lambda acc, g: acc + F.get(table, g))

        def scored(grams: Column) -> Column:
            n = F.size(grams)
            each = [
                F.struct(
                    total(grams, t).alias("score"),
                    (F.lit(m - SLACK) * n - F.lit(SIGMAS * d) * F.sqrt(n.cast("double"))).alias("least"),
                    F.lit(lang).alias("lang"),
                )
                for lang, t, m, d in zip(self.langs, tables, self.mean, self.deviation, strict=True)
            ]
            return F.array(*each)

        def shared(found: Column) -> Column:
            top = F.array_max(F.transform(found, lambda x: x.score))
            known = F.exists(found, lambda x: (x.score == top) & (x.score >= x.least))
            odds = F.transform(found, lambda x: F.struct(x.lang.alias("lang"), F.exp((x.score - top) / 3000.0).alias("p")))

            def normed(o: Column) -> Column:
                total = F.aggregate(o, F.lit(0.0), lambda acc, x: acc + x.p)
                return F.filter(F.transform(o, lambda x: F.struct(x.lang.alias("lang"), (x.p / total).alias("p"))), lambda x: x.p >= 0.0001)

            none = F.array().cast("array<struct<lang:string,p:double>>")
            return F.when(known, let(odds, normed)).otherwise(none)

        none = F.array().cast("array<struct<lang:string,p:double>>")
        return let(ngrams(text), lambda g: F.when(F.size(g) > 0, let(scored(g), shared)).otherwise(none))

    def detect(self, docs: DataFrame, mode: str = "document", text_col: str = "text", key: str = "doc_id", min_probability: float = 0.1, max_languages: int = 5) -> DataFrame:
        """key, lang, probability, rank: as language.detect_languages(), where segments need three letters of any script."""
        worth = lambda s: F.length(F.regexp_replace(s, r"\P{L}+", "")) >= 3
        return _ranked(docs, key, F.coalesce(F.col(text_col), F.lit("")), mode, self.judge, worth, min_probability, max_languages)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """A model of all languages of ``docs``. Counts by language and bucket come to the driver: 3 * BUCKETS a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(ngrams(F.coalesce(F.col(text_col), F.lit("")))).alias("g"))
    found = rows.groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas()
    langs = tuple(sorted(found["lang"].unique()))
    if not langs:
        raise ValueError("no labelled text to train on")
    weights, mean, deviation = [], [], []
    for lang in langs:
        own = found[found["lang"] == lang]
        counts = np.zeros(3 * BUCKETS)
        counts[own["g"].to_numpy()] = own["n"].to_numpy()
        totals = np.repeat(counts.reshape(3, BUCKETS).sum(axis=1), BUCKETS)
        w = [round(1000 * math.log((c + 0.5) / (t + BUCKETS / 2))) for c, t in zip(counts, totals, strict=True)]
        share = counts / counts.sum()
        m = float(np.dot(share, w))
        weights.append(tuple(w))
        mean.append(m)
        deviation.append(math.sqrt(max(0.0, float(np.dot(share, np.square(w))) - m * m)))
    return LanguageModel(langs, tuple(weights), tuple(mean), tuple(deviation))
