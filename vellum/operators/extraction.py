"""Typed validation of a model's JSON replies, on VARIANT.

Each field of a reply is told by its JSON type: null, blank or missing values aren't found and have confidence 0; a number that can't be
read as one has .3, an array that isn't a list .2, anything else .9. A number may come as a JSON number, as true or false (1 and 0), or as a string of digits
with sign and point. A reply that holds no JSON object finds nothing. Values of strings are themselves, others are their JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.jsontext import json_text
from vellum.functions.spans import let

KINDS = ("string", "number", "array")
NUMERAL = r"^\s*[+-]?(?:\d+|\d+\.\d*|\.\d+)\s*$|^\s*[+-]?(?:\d+\.\d*|\.\d+)[eE][+-]?\d+\s*$"


@dataclass(frozen=True)
class ReplyField:
    key: str
    type: str = "string"
    label: str | None = None


def _judged(doc: Column, f: ReplyField) -> Column:
    """(value, number, confidence, label, found) of one field."""
    if f.type not in KINDS:
        raise ValueError(f"{f.key}: type is one of {', '.join(KINDS)}")
    if "'" in f.key and '"' in f.key:
        raise ValueError(f"{f.key}: a key can't hold both kinds of quotation marks")
    path = f'$["{f.key}"]' if "'" in f.key else f"$['{f.key}']"

    def judged(v: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind != "VOID", F.to_json(v))
        found = F.coalesce(text != "", F.lit(False))
        numeral = F.when(kind == "STRING", F.when(text.rlike(NUMERAL), F.trim(text).try_cast("double")))
        number = numeral if f.type != "number" else F.when(kind == "STRING", numeral).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        sure = F.lit(0.9)
        if f.type == "number":
            sure = F.when(number.isNull(), 0.3).otherwise(0.9)
        elif f.type == "array":
            sure = F.when(kind.startswith("ARRAY"), 0.9).otherwise(0.2)
        return F.struct(
            F.when(found, text).alias("value"),
            F.when(found, number if f.type == "number" else F.lit(None).cast("double")).alias("number"),
            F.when(found, sure).otherwise(0.0).alias("confidence"),
            F.lit(f.label or f.key).alias("label"),
            found.alias("found"),
        )

    return let(F.try_variant_get(doc, path, "variant"), judged)


def validate_replies(rows: DataFrame, fields: list[ReplyField], reply: str = "reply") -> DataFrame:
    """``rows`` with extracted, a map of key to (value, number, confidence, label, found), and total_fields, matched, unmatched, match_rate. Narrow."""
    if not fields:
        raise ValueError("no fields")
    parsed = F.try_parse_json(json_text(F.col(reply)))
    entries = lambda doc: F.map_from_entries(F.array(*[F.struct(F.lit(f.key).alias("k"), _judged(doc, f).alias("v")) for f in fields]))
    out = rows.withColumn("extracted", let(parsed, entries))
    matched = F.size(F.filter(F.map_values("extracted"), lambda x: x.found))
    return out.withColumns(
        {
            "total_fields": F.lit(len(fields)),
            "matched": matched,
            "unmatched": F.lit(len(fields)) - matched,
            "match_rate": F.round(matched / len(fields), 4),
        }
    )
