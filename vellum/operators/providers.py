"""Operators around a model: prompt, reply, parsed answer with defaults. The model is a parameter.

A provider is a Column function from prompt to reply: a pandas UDF that calls a service, or ``offline``, which answers by rule and
always alike, so plans can be tested without a model. Only prompts, parsing and defaults are this library's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.jsontext import parse_reply
from vellum.functions.text import sentences, strip

Provider = Callable[[Column], Column]
#: Characters of a text that a model with a short context can be given, as ``cap``; by default a prompt holds the whole text.
CAPS = {"extract": 12_000, "gap": 8_000, "sentiment": 8_000, "critic": 2_000}
STYLES = {"short": 1, "long": 5, "bullet_points": 3, "executive": 2}


def offline(prompt: Column) -> Column:
    """An empty JSON object for any prompt: every default applies."""
    return F.when(prompt.isNotNull(), F.lit("{}"))


def _capped(text_col: str, cap: int | None) -> Column:
    return F.col(text_col) if cap is None else F.substring(text_col, 1, cap)


def batched(call: Callable[[list[str]], list[str]]) -> Provider:
    """A provider from a function on lists of prompts; one call for each Arrow batch, across documents."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield pd.Series(call(prompts.tolist()), dtype="object")

    return run


def semantic_extract(docs: DataFrame, fields: list[str], provider: Provider = offline, text_col: str = "text", cap: int | None = None) -> DataFrame:
    """``docs`` with extracted: map of key to (value, confidence, found). Narrow.

    A value that is null or blank has confidence 0; the model's own confidence holds otherwise, .9 if it gives none.
    """
    asked = F.concat(F.lit("Extract these fields as JSON: " + ", ".join(fields) + "\n\n"), _capped(text_col, cap))
    schema = "struct<" + ",".join(f"`{f}`:struct<value:string,confidence:double>" for f in fields) + ">"
    rows = docs.withColumn("_r", parse_reply(provider(asked), schema))

    def one(f: str) -> Column:
        value = F.nullif(strip(F.col(f"_r.`{f}`.value")), F.lit(""))
        sure = F.when(value.isNull(), 0.0).otherwise(F.coalesce(F.col(f"_r.`{f}`.confidence"), F.lit(0.9)))
        return F.struct(value.alias("value"), sure.alias("confidence"), value.isNotNull().alias("found"))

    return rows.withColumn("extracted", F.create_map(*[x for f in fields for x in (F.lit(f), one(f))])).drop("_r")


def sentiment(docs: DataFrame, provider: Provider = offline, text_col: str = "text", cap: int | None = None) -> DataFrame:
    """``docs`` with sentiment (polarity, score, confidence) and summary; neutral and 0 by default. Narrow."""
    asked = F.concat(F.lit("Rate the sentiment as JSON.\n\n"), _capped(text_col, cap))
    rows = docs.withColumn("_r", parse_reply(provider(asked), "struct<polarity:string,score:double,confidence:double,summary:string>"))
    found = F.struct(
        F.coalesce("_r.polarity", F.lit("neutral")).alias("polarity"),
        F.coalesce("_r.score", F.lit(0.0)).alias("score"),
        F.coalesce("_r.confidence", F.lit(0.0)).alias("confidence"),
    )
    return rows.withColumn("sentiment", found).withColumn("summary", F.coalesce("_r.summary", F.lit(""))).drop("_r")


def summarize(docs: DataFrame, style: str = "short", provider: Provider | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with summary: the provider's, or else the text's first sentences. Narrow."""
    if provider:
        return docs.withColumn("summary", provider(F.concat(F.lit(f"Summarize ({style}):\n\n"), F.col(text_col))))
    first = F.slice(F.filter(F.transform(sentences(F.col(text_col)), strip), lambda s: s != ""), 1, STYLES[style])
    if style == "bullet_points":
        return docs.withColumn("summary", F.array_join(F.transform(first, lambda s: F.concat(F.lit("- "), s)), "\n"))
    return docs.withColumn("summary", F.array_join(first, " "))


def translate(docs: DataFrame, source: str, target: str, provider: Provider | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with translated_text: the text itself if the languages are the same. Narrow."""
    if source == target:
        return docs.withColumn("translated_text", F.col(text_col))
    if provider is None:
        raise RuntimeError(f"no translator from {source} to {target} is installed")
    return docs.withColumn("translated_text", provider(F.col(text_col)))


def answers(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """``rows`` with answer and confidence from replies: bad JSON is the answer itself, at low confidence. Narrow."""
    r = parse_reply(F.col(reply), "struct<answer:string,confidence:string>")
    ok = r["answer"].isNotNull()
    return rows.withColumn("answer", F.when(ok, r["answer"]).otherwise(F.col(reply))).withColumn(
        "confidence", F.when(ok, F.coalesce(r["confidence"], F.lit("medium"))).otherwise("low")
    )


def plan_steps(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """``rows`` with steps: array of (agent, instruction); bad JSON has none. Narrow."""
    kind = "array<struct<agent:string,instruction:string>>"
    r = parse_reply(F.col(reply), f"struct<steps:{kind}>")
    return rows.withColumn("steps", F.coalesce(r["steps"], F.array().cast(kind)))


def ask_table(rows: DataFrame, aggregation: str, column: str) -> DataFrame:
    """A question on numbers put as an aggregation: answered by Spark, not by a model."""
    return rows.agg(getattr(F, aggregation)(column).alias("answer"))


def interpret_images(images: DataFrame, provider: Provider, content: str = "content") -> DataFrame:
    """``images`` with interpretation, by a provider that takes binary. Narrow."""
    return images.withColumn("interpretation", provider(F.col(content)))


def feedback_categories(rows: DataFrame, provider: Provider = offline, categories: tuple[str, ...] = ("other",)) -> DataFrame:
    """``rows`` with category of negative feedback: one of ``categories``, else "other". Narrow."""
    found = parse_reply(provider(F.col("correction")), "struct<category:string>")["category"]
    return rows.withColumn("category", F.when(F.col("sentiment") == "negative", F.when(found.isin(*categories), found).otherwise("other")))
