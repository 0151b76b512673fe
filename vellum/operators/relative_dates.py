"""Relative dates ("in 3 days", "demain à 10h", "next Monday") against a column with the reference time, and all kinds of dates in one pass.

The grammar is this library's own, for each language of LANGUAGES in that order: words for days, a number of units to come or gone, the next
or last unit, the next or last weekday, each with an optional time of day. Months and years go by calendar, to the last day of a shorter
month; hours and minutes move the time too. A span that an earlier language took hides what later ones find over it; so do dates of the
Hijri calendar, and those with a day, month and year, which are looked for before.

Edge cases: a null text or reference has no relative dates. Numbers are whole and of six digits at most. Offsets that leave the years 1 to 9999 are no dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.spans import let, matches, replace_spans
from vellum.operators.date_normalizer import FORMATS, MONTHS, find_dates, hijri_months

#: Words of each language. Units: (months, days, seconds).
UNITS = {"day": (0, 1, 0), "week": (0, 7, 0), "month": (1, 0, 0), "year": (12, 0, 0), "hour": (0, 0, 3600), "minute": (0, 0, 60)}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
LANGUAGES = {
    "fr": {
        "words": {"avant-hier": -2, "après-demain": 2, "apres-demain": 2, "aujourd'hui": 0, "aujourd’hui": 0, "hier": -1, "demain": 1},
        "units": {"day": "jours?", "week": "semaines?", "month": "mois", "year": "ans?|années?|annees?", "hour": "heures?", "minute": "minutes?"},
        "numbers": "un|une deux trois quatre cinq six sept huit neuf dix".split(),
        "later": r"dans\s+{n}\s+{u}",
        "earlier": r"il\s+y\s+a\s+{n}\s+{u}",
        "next": r"(?:(?:la|le)\s+|l['’])?{u}\s+prochaine?",
        "last": r"(?:(?:la|le)\s+|l['’])?{u}\s+(?:derni[eè]re?|pass[ée]e?)",
        "days": "lundi mardi mercredi jeudi vendredi samedi dimanche".split(),
        "next_day": r"{d}\s+prochain",
        "last_day": r"{d}\s+dernier",
        "clock": r"\s+[àa]\s+(\d{1,2})\s*(?:h|heures?|:)\s*([0-5]\d)?()",
    },
    "en": {
        "words": {"the day before yesterday": -2, "the day after tomorrow": 2, "yesterday": -1, "today": 0, "tomorrow": 1},
        "units": {"day": "days?", "week": "weeks?", "month": "months?", "year": "years?", "hour": "hours?", "minute": "minutes?"},
        "numbers": "one|an|a two three four five six seven eight nine ten".split(),
        "later": r"(?:in\s+{n}\s+{u}|{n}\s+{u}\s+from\s+now)",
        "earlier": r"{n}\s+{u}\s+ago",
        "next": r"next\s+{u}",
        "last": r"last\s+{u}",
        "days": "monday tuesday wednesday thursday friday saturday sunday".split(),
        "next_day": r"next\s+{d}",
        "last_day": r"last\s+{d}",
        "clock": r"\s+at\s+(\d{1,2})(?::([0-5]\d))?\s*(am|pm)?",
    },
    "ar": {
        "words": {"بعد غد": 2, "أول أمس": -2, "اليوم": 0, "أمس": -1, "غداً": 1, "غدا": 1},
        "units": {"day": "أيام|ايام|يوماً|يوما|يوم", "week": "أسابيع|اسابيع|أسبوع|اسبوع", "month": "أشهر|شهور|شهر", "year": "سنوات|سنة|أعوام|عام", "hour": "ساعات|ساعة", "minute": "دقائق|دقيقة"},
        "numbers": "واحد اثنين ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة عشرة".split(),
        "later": r"بعد\s+{n}\s+{u}",
        "earlier": r"(?:قبل|منذ)\s+{n}\s+{u}",
        "next": r"ال(?:{u})\s+(?:القادمة|القادم|المقبلة|المقبل)",
        "last": r"ال(?:{u})\s+(?:الماضية|الماضي)",
        "days": "الاثنين الثلاثاء الأربعاء الخميس الجمعة السبت الأحد".split(),
        "next_day": r"{d}\s+(?:القادم|المقبل)",
        "last_day": r"{d}\s+الماضي",
        "clock": r"\s+(?:على\s+)?الساعة\s+(\d{1,2})(?::([0-5]\d))?()",
    },
}
_FIELDS = "array<struct<start:int,end:int,original:string,normalized:string,iso_date:string,iso_datetime:string,has_time:boolean,calendar:string,detected_language:string,is_relative:boolean>>"


def _filled(rule: str, lang: dict, n: str = r"(?:\d{{1,6}}|{numbers})") -> str:
    numbers = "|".join(lang["numbers"])
    return rule.format(n=n.format(numbers=numbers), u="(?:" + "|".join(lang["units"].values()) + ")", d="(?:" + "|".join(lang["days"]) + ")")


def pattern(lang: dict) -> str:
    words = "|".join(sorted(lang["words"], key=len, reverse=True))
    rules = "|".join(_filled(lang[k], lang) for k in ("later", "earlier", "next_day", "last_day", "next", "last"))
    clock = lang["clock"].replace("()", "")
    return rf"(?iU)(?<![\w'’-])(?:{words}|{rules})(?:{clock})?(?![\w-])"


def _moved(value: Column, lang: dict, reference: Column) -> Column:
    """(at, timed): the moment that a matched string means, and whether it tells a time of day."""
    units = list(UNITS)

    def parts(low: Column) -> Column:
        is_ = lambda rule: low.rlike(rf"(?U)^(?:{_filled(lang[rule], lang)})")
        day, unit, weekday, number = (F.lit(None).cast("int") for _ in range(4))
        for word, offset in sorted(lang["words"].items(), key=lambda x: len(x[0])):  # the longest one is asked first
            day = F.when(low.startswith(word), offset).otherwise(day)
        for k, name in enumerate(units):
            unit = F.when(low.rlike(rf"(?U)(?<!\w)(?:ال)?(?:{lang['units'][name]})(?!\w)"), k).otherwise(unit)
        for k, own in enumerate(lang["days"]):
            weekday = F.when(low.contains(own), k).otherwise(weekday)
        told = F.regexp_extract(low, rf"(?U)(?<!\w)(\d{{1,6}}|{'|'.join(lang['numbers'])})(?!\w)", 1)
        for k, names in enumerate(lang["numbers"], 1):
            number = F.when(told.isin(*names.split("|")), k).otherwise(number)
        rule = F.when(is_("later"), 1).when(is_("earlier"), 2).when(is_("next_day"), 3).when(is_("last_day"), 4).when(is_("next"), 5).when(is_("last"), 6)
        clock = [F.regexp_extract(low, rf"(?U){lang['clock']}$", k).alias(name) for k, name in ((1, "h"), (2, "m"), (3, "half"))]
        return F.struct(day.alias("day"), unit.alias("unit"), weekday.alias("weekday"), F.coalesce(told.try_cast("int"), number).alias("n"), F.when(day.isNull(), rule).alias("rule"), *clock)

    def moment(p: Column) -> Column:
        sign = F.when(p["rule"] == 1, p["n"]).when(p["rule"] == 2, -p["n"]).when(p["rule"] == 5, 1).when(p["rule"] == 6, -1)
        by = [F.get(F.array(*[F.lit(UNITS[u][k]) for u in units]), p["unit"]).cast("long") * sign for k in range(3)]
        at = F.get(F.array(*map(F.lit, WEEKDAYS)), p["weekday"])
        date = reference.cast("date")
        named = F.when(p["rule"] == 3, F.call_function("next_day", date, at)).when(p["rule"] == 4, F.call_function("next_day", F.date_sub(date, 8), at))
        near = by[0].between(-119_988, 119_988) & by[1].between(-3_652_000, 3_652_000)
        shifted = F.date_add(F.add_months(date, F.when(near, by[0]).cast("int")), F.when(near, by[1]).cast("int"))
        whole = F.coalesce(F.date_add(date, p["day"]), named, shifted)
        h = p["h"].try_cast("int")
        hour = F.when((p["half"] == "pm") & (h < 12), h + 12).when((p["half"] == "am") & (h == 12), 0).otherwise(h)
        clock = F.when(hour.between(0, 23), hour * 3600 + F.coalesce(p["m"].try_cast("int"), F.lit(0)) * 60)
        return F.struct(whole.alias("date"), F.when(p["day"].isNull() & (F.abs(by[2]) < 10**10), F.nullif(by[2], F.lit(0).cast("long"))).alias("seconds"), clock.alias("clock"))

    def told(m: Column) -> Column:
        add = lambda base, seconds: F.timestamp_seconds(F.unix_seconds(base) + seconds)
        at = F.when(m["seconds"].isNotNull(), add(reference.cast("timestamp"), m["seconds"])).otherwise(add(m["date"].cast("timestamp"), F.coalesce(m["clock"], F.lit(0))))
        return F.struct(at.alias("at"), (m["seconds"].isNotNull() | m["clock"].isNotNull()).alias("timed"))

    def known(r: Column) -> Column:
        return F.struct(F.when(F.year(r["at"]).between(1, 9999), r["at"]).alias("at"), r["timed"].alias("timed"))

    return let(let(let(let(F.lower(value), parts), moment), told), known)


def _relative(text: Column, reference: Column, code: str, fmt: str) -> Column:
    lang = LANGUAGES[code]

    def told(m: Column) -> Column:
        def build(r: Column) -> Column:
            return F.struct(
                m.start.alias("start"),
                m.end.alias("end"),
                F.substring(text, m.start + 1, m.end - m.start).alias("original"),
                F.date_format(r["at"], FORMATS[fmt]).alias("_d"),
                F.date_format(r["at"], "yyyy-MM-dd").alias("iso_date"),
                F.date_format(r["at"], "yyyy-MM-dd'T'HH:mm:ss").alias("iso_datetime"),
                F.date_format(r["at"], "HH:mm:ss").alias("_t"),
                F.coalesce(r["timed"], F.lit(False)).alias("has_time"),
            )

        return let(_moved(m.value, lang, reference), build)

    def named(x: Column) -> Column:
        normalized = F.concat(x["_d"], F.when(x.has_time, F.concat(F.lit(" "), x["_t"])).otherwise(""))
        return F.struct(x.start, x.end, x.original, normalized.alias("normalized"), x.iso_date, x.iso_datetime, x.has_time, F.lit("gregorian").alias("calendar"), F.lit(code).alias("detected_language"), F.lit(True).alias("is_relative"))

    found = F.transform(matches(tx.fold_digits(text), pattern(lang)), told)
    return F.transform(F.filter(found, lambda x: x.iso_date.isNotNull()), named).cast(_FIELDS)


def _absolute(text: Column, fmt: str, day_first: bool, hijri: list[int] | None) -> Column:
    def month_language(original: Column) -> Column:
        """The language whose month the date names, by the names of MONTHS: Latin letters with English months are English."""
        english = "|".join(v.split()[0] for v in MONTHS.values()) + "|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
        return (
            F.when(original.rlike(r"[؀-ۿ]"), "ar")
            .when(original.rlike(rf"(?iU)(?<!\w)(?:{english})(?!\w)"), "en")
            .when(original.rlike(r"(?iU)(?<!\w)(?:janvier|janv|février|fevrier|févr|mars|avril|avr|mai|juin|juillet|juil|août|aout|septembre|octobre|novembre|décembre|decembre)(?!\w)"), "fr")
            .when(original.rlike(r"(?U)\p{L}{3}"), "other")
            .otherwise("fr")
        )

    def filled(x: Column) -> Column:
        time = F.when(x.has_time, F.concat(F.lit("T"), F.right(x.normalized, F.lit(8)))).otherwise("T00:00:00")
        language = F.when(x.calendar == "hijri", "ar").otherwise(month_language(x.original))
        return F.struct(x.start, x.end, x.original, x.normalized, x.iso_date, F.concat(x.iso_date, time).alias("iso_datetime"), x.has_time, x.calendar, language.alias("detected_language"), F.lit(False).alias("is_relative"))

    return F.transform(find_dates(text, fmt, day_first, hijri), filled).cast(_FIELDS)


def find_all_dates(docs: DataFrame, reference: str, text_col: str = "text", fmt: str = "YYYY-MM-DD", day_first: bool = True, hijri: bool = True) -> DataFrame:
    """``docs`` with dates, an array in order of (start, end, original, normalized, iso_date, iso_datetime, has_time, calendar, detected_language,
    is_relative), and normalized_text. ``reference`` names the column with the time that relative dates count from. Narrow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    free = lambda later, taken: F.filter(later, lambda x: ~F.exists(taken, lambda y: (x.start < y.end) & (y.start < x.end)))
    rows = docs.withColumn("dates", _absolute(text, fmt, day_first, hijri_months(docs.sparkSession) if hijri else None))
    for code in LANGUAGES:
        rows = rows.withColumn("_more", F.when(F.col(reference).isNotNull(), _relative(text, F.col(reference), code, fmt)).otherwise(F.array().cast(_FIELDS)))
        rows = rows.withColumn("dates", F.concat("dates", free(F.col("_more"), F.col("dates")))).drop("_more")
    rows = rows.withColumn("dates", F.array_sort("dates"))
    return rows.withColumn("normalized_text", F.when(F.col(text_col).isNotNull(), replace_spans(text, F.col("dates"), lambda s: s["normalized"])))
