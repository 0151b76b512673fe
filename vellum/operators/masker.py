"""Personal data: found by pattern and validator, resolved to disjoint spans, masked in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.spans import greedy, matches, replace_spans, typed

#: Patterns and priorities by kind.
IBAN = r"(?iU)(?<![A-Z0-9])[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]){11,30}(?![A-Z0-9])"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
EMAIL = r"(?iU)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])"
IPV4 = r"(?U)(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"
ID = (
    r"(?iU)(?<!\w)(?:CIN|ID|IDENTIFIER|IDENTIFIANT|PASSPORT|PASSEPORT|MATRICULE|SSN|NIR|N[°O]?\s*(?:CARTE|IDENTIT[ÉE]|PASSEPORT)|"
    r"رقم\s*(?:الهوية|البطاقة|بطاقة\s*التعريف|جواز\s*السفر)|بطاقة\s*التعريف)\s*[:#№-]?\s*[A-Z0-9][A-Z0-9./_-]{4,30}(?!\w)"
)
PHONE = r"(?U)(?<![\w/])(?:\+|00)?\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}[ .-]?\d{2,4}(?![\w/])"
ADDRESS = (
    r"(?iU)(?<!\w)\d{1,5}(?:\s*(?:bis|ter))?\s+(?:[A-ZÀ-ÖØ-öø-ÿ0-9'’.-]+\s+){0,7}"
    r"(?:rue|avenue|av\.?|boulevard|bd\.?|route|chemin|impasse|place|quai|street|st\.?|road|rd\.?|lane|drive|square)"
    r"(?:\s+[A-ZÀ-ÖØ-öø-ÿ0-9'’.-]+){0,8}(?!\w)"
)
ARABIC_ADDRESS = r"(?iU)(?<!\w)(?:\d{1,5}\s+)?(?:شارع|نهج|طريق|حي|إقامة|اقامة)(?:\s+[؀-ۿ0-9٠-٩-]+){1,7}(?!\w)"
PRIORITY = {"IBAN": 100, "CARD": 95, "EMAIL": 90, "IP_ADDRESS": 88, "ID": 85, "PHONE": 70, "ADDRESS": 60}
KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "FINANCIAL", "IP_ADDRESS")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(7, 15)


def is_ipv4(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.rlike(r"^(0|[1-9][0-9]{0,2})$") & (F.try_to_number(o, F.lit("999")) <= 255))


def detections(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """All candidates, overlaps included: array of (start, rank, longest, end, type, value)."""
    parts = []
    if "FINANCIAL" in kinds:
        parts.append(typed(matches(text, IBAN), "FINANCIAL", PRIORITY["IBAN"]))
        parts.append(typed(F.filter(matches(text, CARD), lambda m: is_card(m.value)), "FINANCIAL", PRIORITY["CARD"]))
    if "EMAIL" in kinds:
        parts.append(typed(matches(text, EMAIL), "EMAIL", PRIORITY["EMAIL"]))
    if "ID" in kinds:
        parts.append(typed(matches(text, ID), "ID", PRIORITY["ID"]))
    if "PHONE" in kinds:
        parts.append(typed(F.filter(matches(text, PHONE), lambda m: is_phone(m.value)), "PHONE", PRIORITY["PHONE"]))
    if "ADDRESS" in kinds:
        parts += [typed(matches(text, p), "ADDRESS", PRIORITY["ADDRESS"]) for p in (ADDRESS, ARABIC_ADDRESS)]
    if "IP_ADDRESS" in kinds:
        parts.append(typed(F.filter(matches(text, IPV4), lambda m: is_ipv4(m.value)), "IP_ADDRESS", PRIORITY["IP_ADDRESS"]))
    return F.concat(*parts)


def sensitive_spans(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with spans: disjoint, in order; (start, rank, longest, end, type, value). Narrow."""
    return docs.withColumn("spans", greedy(detections(F.coalesce(F.col(text_col), F.lit("")), kinds)))


def mask_text(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS, mask: str = "█") -> DataFrame:
    """``docs`` with masked_text (a mark for each masked character), total_masked and by_type. Narrow."""
    rows = sensitive_spans(docs, text_col, kinds)
    counted = F.map_from_entries(F.transform(F.array(*map(F.lit, kinds)), lambda k: F.struct(k, F.size(F.filter("spans", lambda s: s.type == k)))))
    return rows.withColumns(
        {
            "masked_text": replace_spans(F.col(text_col), F.col("spans"), lambda s: F.repeat(F.lit(mask), s["end"] - s["start"])),
            "total_masked": F.size("spans"),
            "by_type": F.map_filter(counted, lambda _, n: n > 0),
        }
    ).drop("spans")


