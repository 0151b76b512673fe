"""Critic with a model: claims that their evidence doesn't bear out go to a provider; its issues and corrections become rows and text.

One prompt for each response with flagged claims, so a response's claims are held together, nothing else. Replies are JSON; what isn't
there, or is no such JSON, counts as no issue, no correction and no claim supported. Responses without claims have accuracy 0, those without flagged ones 1.
Null texts have no claims and stay null. Corrections apply in their order, each to the first place where its original stands then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.jsontext import parse_reply
from vellum.operators.providers import Provider, offline

REPLY = (
    "struct<supported_count:int,issues:array<struct<severity:string,claim:string,description:string,suggestion:string>>,"
    "corrections:array<struct<original:string,corrected:string,reason:string>>>"
)


def flagged_prompt(flagged: Column) -> Column:
    """``flagged``: array of (claim_index, claim, similarity, evidence)."""
    asked = F.transform(flagged, lambda c, i: F.concat(F.lit("["), i + 1, F.lit("] CLAIM (similarity "), c.similarity.cast("string"), F.lit("): "), c.claim, F.lit("\nEVIDENCE: "), c.evidence))
    return F.concat(F.lit("Is each claim supported by its evidence? Answer as JSON: supported_count, issues, corrections.\n\n"), F.array_join(asked, "\n\n"))


def by_severity(issues: Column) -> Column:
    """Issues with high ones first, then medium, then all others; equal ones in their order."""
    rank = F.transform(issues, lambda x, i: F.struct(F.when(x.severity == "high", 0).when(x.severity == "medium", 1).otherwise(2).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(rank), lambda y: y.x)


def apply_corrections(text: Column, corrections: Column) -> Column:
    """``text`` after each correction has replaced the first place of its original; blank ones are passed over."""

    def one(done: Column, c: Column) -> Column:
        at = F.position(c.original, done)
        replaced = F.concat(F.substring(done, F.lit(1), at - 1), c.corrected, F.substr(done, at + F.char_length(c.original)))
        return F.when((F.char_length(c.original) > 0) & (F.char_length(c.corrected) > 0) & (at > 0), replaced).otherwise(done)

    return F.aggregate(corrections, text, one)


def review_hybrid(
    responses: DataFrame, claims: DataFrame, key: str, text_col: str = "text", provider: Provider = offline, threshold: float = 0.75, max_issues: int = 5
) -> DataFrame:
    """``responses`` (key, text) judged by their ``claims`` (key, claim_index, claim, max_similarity, evidence).

    Returns key, total_claims, passed_claims, confidence_score, is_supported, issues (the worst ``max_issues``), corrections (all),
    corrected_response, factual_accuracy, source_alignment, consistency. One shuffle of the claims, one join by key.
    """
    similarity = F.round(F.coalesce("max_similarity", F.lit(0.0)), 4)
    passed = F.coalesce(F.col("max_similarity"), F.lit(0.0)) >= threshold
    one = F.struct("claim_index", "claim", similarity.alias("similarity"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    summed = claims.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(passed).alias("passed_claims"),
        F.avg(similarity).alias("_alignment"),
        F.avg(F.when(~passed, similarity)).alias("_flagged_mean"),
        F.array_sort(F.collect_list(F.when(~passed, one))).alias("_flagged"),
    )
    rows = responses.select(key, F.col(text_col).alias("_text")).join(summed, key, "left").withColumn("_any", F.coalesce(F.size("_flagged") > 0, F.lit(False)))
    # The reply is bound by a column of its own, and asked for once, only where claims are flagged.
    asked = rows.withColumn("_reply", provider(F.when(F.col("_any"), flagged_prompt(F.col("_flagged")))))
    told = asked.withColumn("_r", F.when(F.col("_any"), parse_reply(F.col("_reply"), REPLY)))
    empty = {n: F.coalesce(F.col(f"_r.{n}"), F.array().cast(told.schema["_r"].dataType[n].dataType)) for n in ("issues", "corrections")}
    total, good = F.coalesce("total_claims", F.lit(0)), F.coalesce("passed_claims", F.lit(0))
    accuracy = F.when(total == 0, 0.0).when(~F.col("_any"), 1.0).otherwise((good + F.coalesce(F.col("_r.supported_count"), F.lit(0))) / total)
    judged = told.select(
        key, "_text", total.alias("total_claims"), good.alias("passed_claims"), accuracy.alias("_a"), "_alignment", "_flagged_mean",
        by_severity(empty["issues"]).alias("_issues"), empty["corrections"].alias("corrections"),
    ).withColumn("_high", F.exists("_issues", lambda x: F.coalesce(x.severity == "high", F.lit(False))))
    confidence = F.when(F.col("_high"), F.greatest(F.lit(0.0), F.col("_a") - 0.3)).otherwise(F.col("_a"))
    return judged.select(
        key, "total_claims", "passed_claims",
        F.round(confidence, 4).alias("confidence_score"),
        ((confidence >= 0.7) & ~F.col("_high") & (F.col("_a") >= threshold)).alias("is_supported"),
        F.slice("_issues", 1, max_issues).alias("issues"),
        "corrections",
        apply_corrections(F.col("_text"), F.col("corrections")).alias("corrected_response"),
        F.round("_a", 4).alias("factual_accuracy"),
        F.round(F.coalesce("_alignment", F.lit(0.0)), 4).alias("source_alignment"),
        F.round(1 - F.coalesce("_flagged_mean", F.lit(0.0)), 4).alias("consistency"),
    )
