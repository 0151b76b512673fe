"""Regex field extraction and completeness checks over rule tables.

Rules are Python literals, so their number is fixed when the plan is made; each becomes a column, and a document is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import let, matches
from vellum.functions.text import strip


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str
    group: int = 0
    category: str = "general"
    required: bool = False
    context_before: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    exact_length: int | None = None


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    severity: str = "WARNING"
    pattern: str | None = None
    method: str = "regex"
    required: bool = False


#: A checklist for French invoices.
INVOICE_FR = [
    Field("numero_facture", "Numero de facture", "CRITICAL", r"(?:N[°o]|Num[ée]ro|Facture)\s*:?\s*(\w+[-/]?\d+)", required=True),
    Field("date", "Date de facturation", "CRITICAL", r"\d{2}[/-]\d{2}[/-]\d{4}", required=True),
    Field("montant", "Montant total", "CRITICAL", r"(\d[\d\s]*[.,]?\d*)\s*(?:DT|€|EUR|TND|TTC)", required=True),
    Field("tva", "TVA", "INFO", r"(?:TVA|T\.V\.A)\s*:?\s*(\d[\d\s]*[.,]?\d*)"),
    Field("fournisseur", "Nom du fournisseur", "CRITICAL", r"(?:Fournisseur|Soci[ée]t[ée]|Raison sociale)\s*:?\s*([\w\s]{3,40})", required=True),
    Field("client", "Nom du client", "WARNING", r"(?:Client|Acheteur|Destinataire)\s*:?\s*([\w\s]{3,40})", required=True),
]
CHECKLISTS = {"invoice_fr": INVOICE_FR}


def _grouped(value: Column, pattern: str, group: int) -> Column:
    whole = F.regexp_extract(value, pattern, 0)
    if not group:
        return whole
    return F.coalesce(F.nullif(F.regexp_extract(value, pattern, group), F.lit("")), whole)


def extract(text: Column, rule: Pattern) -> Column:
    """(value, confidence, found) of one rule."""
    pattern = "(?iU)" + rule.pattern
    valid = F.lit(True)
    if rule.context_before:
        near = "(?iU)" + rule.context_before
        around = lambda m: F.substring(text, F.greatest(m.start - 79, F.lit(1)), F.least(m.start + 80, F.lit(160))).rlike(near)
        pick = let(matches(text, pattern), lambda all_: F.struct(F.get(F.filter(all_, around), F.lit(0)).value.alias("near"), F.get(all_, F.lit(0)).value.alias("first")))
        raw, used = F.coalesce(pick["near"], pick["first"]), pick["near"].isNotNull()
        value = strip(_grouped(raw, pattern, rule.group))
    else:
        raw, used = F.when(text.rlike(pattern), text), F.lit(False)
        value = strip(_grouped(raw, pattern, rule.group))
    n = F.char_length(value)
    for limit, test in ((rule.min_length, lambda k: n >= k), (rule.max_length, lambda k: n <= k), (rule.exact_length, lambda k: n == k)):
        if limit is not None:
            valid = valid & test(limit)
    found = value.isNotNull() & valid
    checked = any(x is not None for x in (rule.min_length, rule.max_length, rule.exact_length))
    sure = F.least(F.lit(1.0), F.round(F.lit(0.8) + F.when(used, 0.1).otherwise(0.0) + (0.1 if checked else 0.0), 4))
    return F.struct(value.alias("value"), F.when(found, sure).otherwise(0.0).alias("confidence"), F.coalesce(found, F.lit(False)).alias("found"))


def extract_fields(docs: DataFrame, rules: list[Pattern], text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document and rule: key, category, name, value, confidence, found, required. Narrow."""
    one = [
        F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("name"), F.lit(r.required).alias("required"), extract(F.col(text_col), r).alias("x"))
        for r in rules
    ]
    rows = docs.select(key, F.explode(F.array(*one)).alias("r"))
    return rows.select(key, "r.category", "r.name", "r.x.value", "r.x.confidence", "r.x.found", "r.required")


def extraction_stats(docs: DataFrame, rules: list[Pattern], text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """key, total_patterns, matched, unmatched, match_rate, missing (required names not found). Narrow."""
    found = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.required).alias("required"), extract(F.col(text_col), r)["found"].alias("found")) for r in rules])
    rows = docs.select(key, found.alias("f"))
    matched = F.size(F.filter("f", lambda x: x.found))
    missing = F.transform(F.filter("f", lambda x: x.required & ~x.found), lambda x: x["name"])
    return rows.select(
        key,
        F.lit(len(rules)).cast("long").alias("total_patterns"),
        matched.cast("long").alias("matched"),
        (len(rules) - matched).cast("long").alias("unmatched"),
        F.round(matched / max(1, len(rules)), 4).alias("match_rate"),
        missing.alias("missing"),
    )


def _gaps(checklist: list[Field], text_col: str, evaluate) -> Column:
    """array of (field, label, severity, required, status, value, method)."""
    out = []
    for f in checklist:
        text = F.coalesce(F.col(text_col), F.lit(""))
        if f.method == "semantic":
            value = evaluate(text, f) if evaluate else F.lit(None).cast("string")
            status = F.when(value.isNotNull(), "MATCHED").otherwise("GAP") if evaluate else F.lit("UNEVALUATED")
            method = F.lit("semantic" if evaluate else "skipped")
        else:
            pattern = "(?iU)" + (f.pattern or r"(?!)")
            has_group = "(" in (f.pattern or "").replace(r"\(", "").replace("(?", "")
            value = F.when(text.rlike(pattern), strip(_grouped(text, pattern, int(has_group))))
            status, method = F.when(value.isNotNull(), "MATCHED").otherwise("GAP"), F.lit("regex")
        parts = {"field": F.lit(f.key), "label": F.lit(f.label), "severity": F.lit(f.severity), "required": F.lit(f.required), "status": status, "value": value, "method": method}
        out.append(F.struct(*[v.alias(k) for k, v in parts.items()]))
    return F.array(*out)


def gap_fields(docs: DataFrame, checklist: list[Field], text_col: str = "text", key: str = "doc_id", evaluate=None) -> DataFrame:
    """A row for each document and field: key, field, label, severity, required, status, value, method. Narrow.

    Regex fields are MATCHED or GAP. Semantic ones go to ``evaluate(text, field) -> Column`` (a value or null); without it
    they are UNEVALUATED.
    """
    return docs.select(key, F.explode(_gaps(checklist, text_col, evaluate)).alias("f")).select(key, "f.*")


def gap_score(docs: DataFrame, checklist: list[Field], text_col: str = "text", key: str = "doc_id", threshold: float = 0.85, evaluate=None) -> DataFrame:
    """key, total_fields, matched, missing_critical, missing_warning, percentage, threshold_exceeded (true: met), missing. Narrow."""
    rows = docs.select(key, _gaps(checklist, text_col, evaluate).alias("f"))
    count = lambda test: F.size(F.filter("f", test)).cast("long")
    critical = lambda x: (x["status"] == "GAP") & (x["severity"] == "CRITICAL")
    out = rows.select(
        key,
        F.size("f").cast("long").alias("total_fields"),
        count(lambda x: x["status"] == "MATCHED").alias("matched"),
        count(critical).alias("missing_critical"),
        count(lambda x: (x["status"] == "GAP") & x["severity"].isin("WARNING", "INFO")).alias("missing_warning"),
        F.array_sort(F.transform(F.filter("f", critical), lambda x: x["field"])).alias("missing"),
    )
    share = F.coalesce(F.try_divide(F.col("matched") * 100, F.col("total_fields")), F.lit(100.0))
    out = out.withColumn("percentage", F.round(share, 1))
    return out.withColumn("threshold_exceeded", F.col("percentage") / 100 >= threshold)
