"""Topic clustering: TF-IDF, K-Means with the number of topics chosen by silhouette, keywords, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import vectors
from vellum.functions.text import strip
from vellum.operators import topics
from vellum.operators.language import STOP_WORDS

MIN_CHARS = 20
WORD = r"[^\W\d_][\w'-]+"


def eligible(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(usable documents, skipped ones with a reason): a text has 20 characters at least once white space is collapsed."""
    n = F.char_length(strip(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+", " ")))
    return docs.where(n >= MIN_CHARS), docs.where(n < MIN_CHARS).withColumn("reason", F.lit("not enough text"))


def terms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, term, tf: lower-case words of two characters at least, counted by document."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit("(?U)" + WORD), F.lit(0))
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, term, weight: (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1), not normalised. Relational, with any vocabulary."""
    counted = terms(docs, key, text_col)
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(df, "term").crossJoin(F.broadcast(total))  # one row
    weight = (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    return joined.select(key, "term", weight.alias("weight"))


def top_terms(weights: DataFrame, by: str, k: int = 5) -> DataFrame:
    """by, term, weight (summed), rank: the heaviest terms of each group; ties go by term."""
    summed = weights.groupBy(by, "term").agg(F.round(F.sum("weight"), 6).alias("weight"))
    order = W.partitionBy(by).orderBy(F.desc("weight"), "term")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cluster_topics(docs: DataFrame, key: str = "doc_id", text_col: str = "text", k: int | None = None, max_k: int = 8, seed: int = 42, min_silhouette: float = 0.035) -> DataFrame:
    """key, cluster, similarity (to the centroid, 4 decimals) for each usable document; see module topics.

    Without ``k``, the number from 2 to ``max_k`` with the best cosine silhouette is taken, and 1 if that is under ``min_silhouette``.
    """
    usable, _ = eligible(docs.select(key, text_col), text_col)
    return topics.topics(usable, key, text_col, k, max_k, seed, min_silhouette)


def cluster_labels(docs: DataFrame, assigned: DataFrame, key: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """cluster, keywords (the ``k`` heaviest terms that are no function words), label: the first three of them."""
    stop = sorted({w for own in STOP_WORDS.values() for w in own})
    weights = tfidf(docs.select(key, text_col), key, text_col).where(~F.col("term").isin(stop))
    best = top_terms(weights.join(assigned.select(key, "cluster"), key), "cluster", k)
    listed = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("keywords"))
    return listed.withColumn("label", F.array_join(F.slice("keywords", 1, 3), " · "))


def cluster_summary(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """cluster, documents, avg_similarity, representative: the most similar document, the least key of equal ones."""
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("similarity"), 4).alias("avg_similarity"), F.min_by(key, F.struct(-F.col("similarity"), key)).alias("representative")
    )


def centroid_similarity(rows: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    """by, key, similarity to the mean vector of its group (4 decimals)."""
    parts = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("_centre"))
    joined = rows.join(centre, by)
    return joined.select(by, key, F.round(vectors.cosine(F.col(vector), F.col("_centre")), 4).alias("similarity"))


