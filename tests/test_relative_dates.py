"""Relative dates in three languages, and how kinds of dates hide each other."""

from datetime import datetime

from vellum.operators.relative_dates import find_all_dates

NOW = datetime(2024, 1, 31, 9, 15, 30)  # a Wednesday
CASES = [
    ("in 3 days", [("in 3 days", "2024-02-03", "en")]),
    ("yesterday and the day before yesterday", [("yesterday", "2024-01-30", "en"), ("the day before yesterday", "2024-01-29", "en")]),
    ("demain à 10h", [("demain à 10h", "2024-02-01 10:00:00", "fr")]),
    ("après-demain à 10h30, hier", [("après-demain à 10h30", "2024-02-02 10:30:00", "fr"), ("hier", "2024-01-30", "fr")]),
    ("Dans un mois; il y a deux ans", [("Dans un mois", "2024-02-29", "fr"), ("il y a deux ans", "2022-01-31", "fr")]),
    ("la semaine prochaine, l'année dernière", [("la semaine prochaine", "2024-02-07", "fr"), ("l'année dernière", "2023-01-31", "fr")]),
    ("Next Wednesday, last Wednesday", [("Next Wednesday", "2024-02-07", "en"), ("last Wednesday", "2024-01-24", "en")]),
    ("in 2 hours", [("in 2 hours", "2024-01-31 11:15:30", "en")]),
    ("45 minutes ago", [("45 minutes ago", "2024-01-31 08:30:30", "en")]),
    ("tomorrow at 12 am, today at 12:05 pm", [("tomorrow at 12 am", "2024-02-01 00:00:00", "en"), ("today at 12:05 pm", "2024-01-31 12:05:00", "en")]),
    ("غدا الساعة 10:30", [("غدا الساعة 10:30", "2024-02-01 10:30:00", "ar")]),
    ("بعد ٣ أيام", [("بعد ٣ أيام", "2024-02-03", "ar")]),
    ("منذ شهر", []),
    ("الشهر الماضي", [("الشهر الماضي", "2023-12-31", "ar")]),
    ("on 29/02/2024 or 3 février 2021, not tomorrowish", [("29/02/2024", "2024-02-29", "fr"), ("3 février 2021", "2021-02-03", "fr")]),
    ("17-01-1437 هـ tomorrow", [("17-01-1437 هـ", "2015-10-30", "ar"), ("tomorrow", "2024-02-01", "en")]),
    ("in 999999 years, a daydream", []),
    ("", []),
    (None, []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, NOW) for i, (t, _) in enumerate(CASES)], "i long, text string, at timestamp_ntz")
    rows = {r.i: r for r in find_all_dates(df, "at").collect()}
    for i, (text, want) in enumerate(CASES):
        got = [(d.original, d.normalized, d.detected_language) for d in rows[i].dates]
        assert got == want, text
        out = text
        for d in reversed(rows[i].dates):
            assert text[d.start : d.end] == d.original
            out = out[: d.start] + d.normalized + out[d.end :]
            assert d.is_relative == (not any(c.isdigit() and len(d.original) > 3 and d.calendar == "hijri" for c in d.original) and "/" not in d.original and "2021" not in d.original)
            assert d.iso_datetime.startswith(d.iso_date) and (d.normalized[11:] or "00:00:00") == (d.iso_datetime[11:] if d.has_time else "00:00:00")
        assert rows[i].normalized_text == out


def test_no_reference_and_another_format(spark):
    df = spark.createDataFrame([(1, "tomorrow, 01/02/2020", None), (2, "tomorrow", NOW)], "i long, text string, at timestamp_ntz")
    rows = {r.i: r.normalized_text for r in find_all_dates(df, "at", fmt="DD/MM/YYYY", hijri=False).collect()}
    assert rows == {1: "tomorrow, 01/02/2020", 2: "01/02/2024"}


def test_a_rule_that_starts_like_another_language(spark):
    """French takes what it knows first; what is left goes to the others."""
    df = spark.createDataFrame([(1, "hier, today, أمس, demain", NOW)], "i long, text string, at timestamp_ntz")
    row = find_all_dates(df, "at").first()
    assert [(d.original, d.detected_language) for d in row.dates] == [("hier", "fr"), ("today", "en"), ("أمس", "ar"), ("demain", "fr")]
