"""JSON out of model replies: fenced blocks, or from the first brace on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(reply: Column) -> Column:
    """The reply's JSON text: what a fence holds, else from the first { to the last }, else the reply."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.trim(F.coalesce(fenced, braces, reply))


def parse_reply(reply: Column, schema: str) -> Column:
    """A struct by ``schema``; its fields are null where the reply is no such JSON."""
    return F.from_json(json_text(reply), schema, {"mode": "PERMISSIVE"})
