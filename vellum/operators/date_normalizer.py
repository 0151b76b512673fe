"""Dates in free text: found, read as day-month-year, written in one format.

The grammar is this library's own (a date is ambiguous without one): numeric dates with / - or . (day first by default, ISO if the
year comes first), day-month-name-year and month-name-day-year in English, French, Spanish, German and Arabic, an optional
time after any of them, and Hijri dates, numeric or by month name, of the years 1300 to 1600. Eastern digits count as digits.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.spans import let, matches, replace_spans

#: Output formats, and month names by number.
FORMATS = {"YYYY-MM-DD": "yyyy-MM-dd", "DD/MM/YYYY": "dd/MM/yyyy", "MM/DD/YYYY": "MM/dd/yyyy"}
MONTHS = {
    1: "january jan janvier janv enero januar jänner يناير جانفي",
    2: "february feb février fevrier févr febrero februar فبراير فيفري",
    3: "march mar mars marzo märz مارس",
    4: "april apr avril avr abril أبريل ابريل أفريل",
    5: "may mai mayo مايو ماي",
    6: "june jun juin junio juni يونيو جوان",
    7: "july jul juillet juil julio juli يوليو جويلية",
    8: "august aug août aout agosto أغسطس اغسطس أوت",
    9: "september sep sept septembre septiembre سبتمبر",
    10: "october oct octobre octubre oktober أكتوبر اكتوبر",
    11: "november nov novembre noviembre نوفمبر",
    12: "december dec décembre decembre diciembre dezember ديسمبر",
}
HIJRI_MONTHS = {
    1: "محرم",
    2: "صفر",
    3: "ربيع الأول|ربيع الاول",
    4: "ربيع الثاني|ربيع الآخر|ربيع الاخر",
    5: "جمادى الأولى|جمادى الاولى",
    6: "جمادى الثانية|جمادى الآخرة|جمادى الاخرة",
    7: "رجب",
    8: "شعبان",
    9: "رمضان",
    10: "شوال",
    11: "ذو القعدة|ذي القعدة",
    12: "ذو الحجة|ذي الحجة",
}
_NAMES = sorted((n for names in MONTHS.values() for n in names.split()), key=len, reverse=True)
_TIME = r"(?:[T ]+(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s*(?:am|pm|صباحاً|صباحا|مساءً|مساء|ص|م))?)?"
_NUMERIC = r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2}))"
_WORDS = r"(?:\d{1,2}(?:st|nd|rd|th|er|\.)?\s+(?:de\s+)?(?:" + "|".join(_NAMES) + r")\.?,?\s+(?:de\s+)?\d{4}|(?:" + "|".join(_NAMES) + r")\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})"
PATTERN = rf"(?iU)(?<![\w./-])(?:{_NUMERIC}|{_WORDS}){_TIME}(?![\w/-])"


def _month(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for number, names in MONTHS.items():
        out = F.when(F.lower(name).isin(*names.split()), F.lit(number)).otherwise(out)
    return out


#: One scan of a matched string: its parts by form (year first, day or month first, day and month's name, month's name and day), then the time.
_FORMS = (
    r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)",
    r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)",
    rf"(\d{{1,2}})(?:st|nd|rd|th|er|\.)?\s+(?:de\s+)?({'|'.join(_NAMES)})\.?,?\s+(?:de\s+)?(\d{{4}})",
    rf"({'|'.join(_NAMES)})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})",
)
_CLOCK = r"\s*T?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm|ص|م|صباحاً|صباحا|مساءً|مساء)?$"
_PARTS = rf"(?isU)^(?:{'|'.join(_FORMS)})(?:.*?{_CLOCK})?.*$"
_CUT = "\u0001"


def parse(value: Column, day_first: bool = True) -> Column:
    """(date, hour, minute, second, has_time) of a matched string; null if it is no date."""
    parts = F.split(F.regexp_replace(value, _PARTS, _CUT.join(f"${k}" for k in range(1, 17))), _CUT, -1)
    return let(parts, lambda p: _read(p, day_first))


def _read(parts: Column, day_first: bool) -> Column:
    g = lambda k: F.nullif(F.get(parts, F.lit(k - 1)), F.lit(""))
    # A string that isn't of any form stays whole, as one part.
    n = lambda k: F.when(F.size(parts) == 16, g(k).cast("int"))
    first, second, short = n(4), n(5), n(6)
    year2 = F.when(F.length(g(6)) == 2, short + F.when(short < 70, 2000).otherwise(1900)).otherwise(short)
    swap = F.when(F.lit(day_first), second > 12).otherwise(first <= 12)
    year = F.coalesce(n(1), year2, n(9), n(12))
    month = F.coalesce(n(2), F.when(swap, first).otherwise(second), _month(F.coalesce(g(8), g(10))))
    day = F.coalesce(n(3), F.when(swap, second).otherwise(first), n(7), n(11))
    return _dated(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"), n(13), n(14), n(15), g(16))


def _dated(date: Column, hour: Column, minute: Column, second: Column, half: Column) -> Column:
    half = F.lower(half)
    late = F.coalesce(half.isin("pm", "م", "مساءً", "مساء"), F.lit(False))
    early = F.coalesce(half.isin("am", "ص", "صباحاً", "صباحا"), F.lit(False))
    at = F.when(late & (hour < 12), hour + 12).when(early & (hour == 12), 0).otherwise(hour)
    return F.struct(
        date.alias("date"),
        F.coalesce(at, F.lit(0)).alias("hour"),
        F.coalesce(minute, F.lit(0)).alias("minute"),
        F.coalesce(second, F.lit(0)).alias("second"),
        hour.isNotNull().alias("has_time"),
    )


def render(parsed: Column, fmt: str = "YYYY-MM-DD") -> Column:
    """The date in one of FORMATS, with the time after it if there is one."""
    date = F.date_format(parsed["date"], FORMATS[fmt])
    time = F.format_string(" %02d:%02d:%02d", parsed["hour"], parsed["minute"], parsed["second"])
    return F.concat(date, F.when(parsed["has_time"], time).otherwise(F.lit("")))


def find_dates(text: Column, fmt: str = "YYYY-MM-DD", day_first: bool = True, hijri: list[int] | None = None) -> Column:
    """array of (start, end, original, normalized, iso_date, has_time, calendar), in order and disjoint. Null if there is no text.

    ``hijri``: the days that ``hijri_months`` gives; Hijri dates are then looked for first, and hide what lies over them.
    """
    gregorian = _found(text, matches(tx.fold_digits(text), PATTERN), lambda v: parse(v, day_first), fmt, "gregorian")
    if hijri is None:
        return gregorian
    other = _found(text, matches(tx.fold_digits(text), HIJRI_PATTERN), lambda v: parse_hijri(v, hijri), fmt, "hijri")

    def merged(both: Column) -> Column:
        free = F.filter(both.g, lambda x: ~F.exists(both.h, lambda y: (x.start < y.end) & (y.start < x.end)))
        return F.array_sort(F.concat(both.h, free))

    return let(F.struct(gregorian.alias("g"), other.alias("h")), merged)


def _found(text: Column, found: Column, read, fmt: str, calendar: str) -> Column:
    return F.transform(
        F.filter(F.transform(found, lambda m: F.struct(m.alias("m"), read(m.value).alias("p"))), lambda r: r.p["date"].isNotNull()),
        lambda r: F.struct(
            r.m.start.alias("start"),
            r.m.end.alias("end"),
            F.substring(text, r.m.start + 1, r.m.end - r.m.start).alias("original"),
            render(r.p, fmt).alias("normalized"),
            F.date_format(r.p["date"], "yyyy-MM-dd").alias("iso_date"),
            r.p["has_time"].alias("has_time"),
            F.lit(calendar).alias("calendar"),
        ),
    )


def normalized_text(text: Column, fmt: str = "YYYY-MM-DD", day_first: bool = True) -> Column:
    return let(find_dates(text, fmt, day_first), lambda found: replace_spans(text, found, lambda s: s["normalized"]))


def normalize_dates(
    docs: DataFrame, text_col: str = "text", fmt: str = "YYYY-MM-DD", day_first: bool = True, limit: int | None = None, hijri: bool = False
) -> DataFrame:
    """``docs`` with dates (all, or the first ``limit``) and normalized_text, in which just these are replaced. Narrow.

    ``hijri``: dates of the Hijri calendar are found too.
    """
    found = find_dates(F.col(text_col), fmt, day_first, hijri_months(docs.sparkSession) if hijri else None)
    rows = docs.withColumn("dates", found if limit is None else F.slice(found, 1, limit))
    return rows.withColumn("normalized_text", replace_spans(F.col(text_col), F.col("dates"), lambda s: s["normalized"]))


#: Years of the Hijri calendar that are known.
HIJRI_YEARS = (1300, 1600)
_MONTHS: list[int] = []
_HIJRI_NAMES = "|".join(n.replace(" ", r"\s+") for alternatives in HIJRI_MONTHS.values() for n in alternatives.split("|"))
HIJRI_PATTERN = (
    rf"(?iU)(?<![\w./-])(?:\d{{1,2}}[./-]\d{{1,2}}[./-]1[2-6]\d{{2}}|\d{{1,2}}\s+(?:{_HIJRI_NAMES})\s+1[2-6]\d{{2}})"
    rf"(?:\s*(?:هـ|هجري|هجرية))?{_TIME}(?!\d)"
)
_HIJRI_PARTS = rf"(?isU)^(?:(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}})|(\d{{1,2}})\s+({_HIJRI_NAMES})\s+(\d{{4}}))(?:.*?{_CLOCK})?.*$"


def hijri_months(spark: SparkSession) -> list[int]:
    """The first day of each Hijri month of HIJRI_YEARS, in days since 1970: a constant of the plan, some 3,600 numbers."""
    if not _MONTHS:
        of = spark._jvm.java.time.chrono.HijrahDate.of
        _MONTHS.extend(of(y, m, 1).toEpochDay() for y in range(HIJRI_YEARS[0], HIJRI_YEARS[1] + 1) for m in range(1, 13))
    return _MONTHS


def parse_hijri(value: Column, months: list[int]) -> Column:
    """As ``parse``, of a string that HIJRI_PATTERN matches. Years that aren't known are no dates."""
    starts = F.from_json(F.lit(json.dumps(months)), "array<int>")

    def read(parts: Column) -> Column:
        g = lambda k: F.nullif(F.get(parts, F.lit(k - 1)), F.lit(""))
        n = lambda k: F.when(F.size(parts) == 10, g(k).cast("int"))
        named = F.lit(None).cast("int")
        for number, alternatives in HIJRI_MONTHS.items():
            named = F.when(F.regexp_replace(g(5), r"\s+", " ").isin(*alternatives.split("|")), F.lit(number)).otherwise(named)
        day, month, year = F.coalesce(n(1), n(4)), F.coalesce(n(2), named), F.coalesce(n(3), n(6))
        known = day.between(1, 30) & month.between(1, 12) & year.between(*HIJRI_YEARS)
        first = F.get(starts, F.when(known, (year - HIJRI_YEARS[0]) * 12 + month - 1))
        return _dated(F.date_add(F.lit("1970-01-01").cast("date"), first + day - 1), n(7), n(8), n(9), g(10))

    return let(F.split(F.regexp_replace(value, _HIJRI_PARTS, _CUT.join(f"${k}" for k in range(1, 11))), _CUT, -1), read)


def find_hijri_dates(docs: DataFrame, text_col: str = "text", key: str = "doc_id", fmt: str = "YYYY-MM-DD") -> DataFrame:
    """(key, start, end, original, normalized) of Hijri dates. Narrow."""
    text = F.col(text_col)
    found = _found(text, matches(tx.fold_digits(text), HIJRI_PATTERN), lambda v: parse_hijri(v, hijri_months(docs.sparkSession)), fmt, "hijri")
    return docs.select(key, F.explode(found).alias("d")).select(key, "d.start", "d.end", "d.original", "d.normalized")
