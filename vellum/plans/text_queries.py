"""Queries on text operators: splitting, cleaning, dates, personal data, rules, languages, comparison, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.jsontext import parse_reply
from vellum.operators import comparison, corpus, date_normalizer, extraction, language, language_model, masker, providers, ranges, regex_extractor, relative_dates, text_cleaner, text_corrector
from vellum.operators.regex_extractor import Field, Pattern
from vellum.operators.text_splitter import split_text
from vellum.session import written
from vellum.sources.tables import load


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _dirty(docs: DataFrame) -> DataFrame:
    """Texts with breaks and runs of space, so that cleaning has something to do."""
    text = F.replace(F.replace(F.replace("text", F.lit("th"), F.lit("t-\nh")), F.lit(". "), F.lit(".  \t ")), F.lit(", "), F.lit(",\n\n\n\n "))
    return docs.withColumn("text", text)


def _chunk_rows(spark, sf_dir):
    return split_text(_docs(spark, sf_dir))


def splitter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir).select("doc_id", "index", "char_start", "char_end", F.md5("text").alias("text_md5"))


def splitter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("char_end") - F.col("char_start")
    return _chunk_rows(spark, sf_dir).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(size).alias("total_chars"), F.round(F.avg(size), 1).alias("avg_chunk_size")
    )


def index_chunks_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _chunk_rows(spark, sf_dir).select("doc_id", tx.strip(F.col("text")).alias("t")).where("t <> ''")
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("t")).alias("chars"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_cleaner.clean_text(_dirty(_docs(spark, sf_dir))).select("doc_id", F.md5("cleaned_text").alias("cleaned_md5"), "original_length", "cleaned_length", "chars_removed")


def clean_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_cleaner.clean_text(_docs(spark, sf_dir), normalize_casing="upper").select("doc_id", F.md5("cleaned_text").alias("cleaned_md5"))


def strip_special_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_cleaner.clean_text(_docs(spark, sf_dir), fix_hyphenation=False, collapse_whitespace=False, strip_special_chars=True)
    return rows.groupBy("lang").agg(F.sum("chars_removed").alias("removed"), F.count_if(F.col("chars_removed") > 0).alias("changed"))


def digit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("east", F.translate("text", "0123456789", tx.EASTERN_DIGITS[:10]))
    return rows.select("doc_id", (tx.fold_digits(F.col("east")) == F.col("text")).alias("same"), F.md5("east").alias("east_md5"), F.md5(tx.fold_digits(F.col("east"))).alias("folded_md5"))


def dates_numeric_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Ordered on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", due 2030-01-31.")).alias("text"))
    rows = date_normalizer.normalize_dates(orders)
    return rows.select("o_orderkey", "normalized_text", F.size("dates").cast("long").alias("n_dates"))


def date_format_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "d.M.yyyy HH:mm").alias("text"))
    out = {f: date_normalizer.normalized_text(F.col("text"), name) for f, name in (("iso", "YYYY-MM-DD"), ("dmy", "DD/MM/YYYY"), ("mdy", "MM/DD/YYYY"))}
    return events.select("event_id", *[c.alias(k) for k, c in out.items()])


def dates_by_month_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "'Le' d MMMM yyyy").alias("text"))
    rows = date_normalizer.normalize_dates(orders)
    return rows.select("o_orderkey", F.get("dates", F.lit(0))["iso_date"].alias("iso_date"))


def dates_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates told from the day of the order, in three languages, one of them with a time and one with a date of its own."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("placed"), (F.col("o_custkey") % 90 + 1).cast("string").alias("n"))
    kind, n = F.col("o_orderkey") % 8, F.col("n")
    text = (
        F.when(kind == 0, F.concat(F.lit("Due in "), n, F.lit(" days, call tomorrow.")))
        .when(kind == 1, F.concat(F.lit("Payé il y a "), n, F.lit(" semaines, livré demain à 10h")))
        .when(kind == 2, F.concat(F.lit("بعد "), n, F.lit(" أيام")))
        .when(kind == 3, F.concat(F.lit("Sent "), n, F.lit(" months ago")))
        .when(kind == 4, F.concat(F.lit("next monday, or on 29/02/2024 not "), n))
        .when(kind == 5, F.lit("le mois prochain, mardi dernier"))
        .when(kind == 6, F.concat(n, F.lit(" years from now at 5:30 pm")))
        .otherwise(F.lit("last year and today"))
    )
    rows = relative_dates.find_all_dates(orders.withColumn("text", text), "placed")
    d = F.col("dates")
    each = lambda f: F.array_join(F.transform(d, f), ",")
    return rows.select("o_orderkey", each(lambda x: x.iso_date).alias("iso_dates"), each(lambda x: x.detected_language).alias("languages"), F.size(F.filter(d, lambda x: x.is_relative)).cast("long").alias("n_relative"), "normalized_text")


def _spans(spark, sf_dir, kind):
    rows = masker.sensitive_spans(_docs(spark, sf_dir), kinds=(kind,))
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.value")


def pii_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "EMAIL").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def pii_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "IP_ADDRESS").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_ip"))


def pii_email_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "EMAIL")


def pii_spans_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masker.sensitive_spans(_docs(spark, sf_dir)).select("lang", F.explode("spans").alias("s"))
    return rows.groupBy("lang", F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


def mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masker.mask_text(_docs(spark, sf_dir), kinds=("EMAIL",), mask="#")
    return rows.select("doc_id", F.md5("masked_text").alias("masked_md5"), F.col("total_masked").cast("long").alias("total_masked"))


def pii_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "FINANCIAL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def pii_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "PHONE").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_phone"))


def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masker.mask_text(_docs(spark, sf_dir))
    return rows.select("doc_id", F.md5("masked_text").alias("masked_md5"), "total_masked", F.to_json("by_type").alias("by_type"))


def span_box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles to redact: e-mail addresses with 40 characters on both sides, against the boxes of the words of their texts."""
    found = masker.sensitive_spans(_docs(spark, sf_dir), kinds=("EMAIL",)).where(F.size("spans") > 0)
    found = written(found.select("doc_id", "text", "spans"), "found")  # read for spans and for words, several times each
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", (F.col("s.start") - 40).alias("start"), (F.col("s.end") + 40).alias("end"))
    return ranges.span_rectangles(spans, ranges.word_boxes(found, "doc_id"), "doc_id", ["doc_id"])


def chunks_without_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that no e-mail address touches."""
    spans = written(_spans(spark, sf_dir, "EMAIL").select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")), "spans")
    rows = ranges.not_overlapping(_chunk_rows(spark, sf_dir), spans, ["doc_id"], ["doc_id", "index"], left_range=("char_start", "char_end"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))


def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_cleaner.clean_text(_dirty(_docs(spark, sf_dir)))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("original_length").alias("original"), F.sum("cleaned_length").alias("cleaned"), F.max("chars_removed").alias("most_removed"))


def gap_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_extractor.gap_fields(_docs(spark, sf_dir), CHECKS).where("status = 'GAP'").select("doc_id", "field", "severity")


def spell_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names torn in two, put together again."""
    text = F.concat(F.lit("from "), F.substring(F.lower("n_name"), 1, 3), F.lit(" "), F.substr(F.lower("n_name"), F.lit(4)), F.lit(" to x"))
    known = load(spark, sf_dir, "nation").where("NOT contains(n_name, ' ')").select(F.lower("n_name").alias("term"), F.lit(1).alias("frequency"))
    merged = text_corrector.correct_text(load(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), known, max_distance=0)
    return merged.select("n_nationkey", "corrected_text", "n_changes")


def spell_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typos planted by rule: words of nine letters have the fifth one twice, words of ten are torn after the fourth. The dictionary: words that occur five times."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(text_corrector.LETTERS), 0)).alias("w"))
    known = written(words.groupBy(F.lower("w").alias("term")).agg(F.count(F.lit(1)).alias("frequency")).where("frequency >= 5"), "dictionary")
    doubled = F.regexp_replace("text", " ([a-z]{4})([a-z])([a-z]{4}) ", " $1$2$2$3 ")
    torn = F.regexp_replace(doubled, " ([a-z]{4})([a-z]{6}) ", " $1 $2 ")
    fixed = text_corrector.correct_text(docs.select("doc_id", torn.alias("text")), known)
    return fixed.select("doc_id", "n_corrections", "n_merges", F.md5("corrected_text").alias("corrected_md5"))


RULES = [
    Pattern("email", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", category="contact", required=True),
    Pattern("secret", r"token = \"([0-9a-f]+)\"", group=1, category="secret", exact_length=40),
    Pattern("first_word", r"[a-z]+", category="general", required=True, max_length=8),
]


def regex_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_extractor.extract_fields(_docs(spark, sf_dir), RULES)


def regex_extract_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regex_extractor.extraction_stats(_docs(spark, sf_dir), RULES)
    return rows.withColumn("missing", F.array_join("missing", ","))


CHECKS = [
    Field("email", "E-mail", "CRITICAL", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", required=True),
    Field("ip", "Address", "WARNING", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    Field("token", "Secret", "INFO", r"token = "),
    Field("the", "Article", "CRITICAL", r"\b(the|der|el|le)\b", required=True),
    Field("tone", "Tone", "INFO", method="semantic"),
]


def gap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_extractor.gap_score(_docs(spark, sf_dir), CHECKS, threshold=0.4).withColumn("missing", F.array_join("missing", ","))


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regex_extractor.gap_fields(_docs(spark, sf_dir), CHECKS)
    return rows.groupBy("field", "severity", "status", "method").agg(F.count(F.lit(1)).alias("n"))


def gap_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    text = F.concat(F.lit("Facture: F"), F.col("o_orderkey"), F.lit("\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("\nMontant: "), F.round("o_totalprice").cast("long"), F.lit(" EUR"))).otherwise(""))
    rows = regex_extractor.gap_score(orders.select("o_orderkey", text.alias("text")), regex_extractor.INVOICE_FR, key="o_orderkey")
    return rows.groupBy("percentage", "matched", "missing_critical", "missing_warning").agg(F.count(F.lit(1)).alias("n"))


def language_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.detect_languages(_docs(spark, sf_dir), mode="document")


def language_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = language.detect_languages(_docs(spark, sf_dir), mode="paragraph").where("rank = 1")
    joined = best.withColumnRenamed("lang", "found").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang", "found").agg(F.count(F.lit(1)).alias("n"))


def language_model_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model trained on four fifths of them."""
    docs = _docs(spark, sf_dir)
    return language_model.train(docs.where("doc_id % 5 <> 0")).detect(docs)


def language_model_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph by paragraph: how often each language came first for the documents that didn't train the model."""
    docs = _docs(spark, sf_dir)
    rows = docs.where("doc_id % 5 = 0").withColumn("id", F.struct("doc_id", "lang"))
    best = language_model.train(docs.where("doc_id % 5 <> 0")).detect(rows, mode="paragraph", key="id").where("rank = 1")
    return best.groupBy(F.col("id.lang").alias("lang"), F.col("lang").alias("found")).agg(F.count(F.lit(1)).alias("n"))


def claim_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.claims(F.col("text"))).alias("c"))
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("claims"), F.sum(F.char_length("c")).alias("chars"))


def line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    other = docs.withColumn("text", F.replace(F.upper("text"), F.lit("."), F.lit(";")))
    return comparison.line_overlap(docs, other, "doc_id", ignore_case=True)


def doc_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"), F.regexp_replace("text", r"\n([^\n]*)\n", "\n").alias("revised"))
    return comparison.compare(docs).select("doc_id", "similarity", "identical", "added", "removed", "modified", "unchanged")


def spell_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "nation").select(F.concat(F.initcap("n_name"), F.lit("x")).alias("word"))
    terms = load(spark, sf_dir, "nation").select(F.lower("n_name").alias("term"), F.lit(1).alias("frequency"))
    return text_corrector.corrections(words, terms)


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))
    return p


def llm_json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    body = F.concat(F.lit('{"role":"'), "role", F.lit('","turn":'), F.col("turn").cast("string"), F.lit("}"))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" ok"))).otherwise(F.lit("no json"))
    found = rows.select("conv_id", "turn", parse_reply(reply, "struct<role:string,turn:bigint>").alias("r"))
    return found.select("conv_id", "turn", F.coalesce("r.role", F.lit("none")).alias("found_role"), F.coalesce("r.turn", F.lit(-1)).alias("found_turn"))


def typed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of replies that hold every type, rightly and wrongly, and break off at times."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("n"), F.substring("text", 1, 40).alias("said"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    n = F.col("n").cast("string")
    size = F.when(kind == 0, n).when(kind == 1, F.concat(F.lit('"'), n, F.lit('.5"'))).when(kind == 2, '"some"').when(kind == 3, "null").otherwise("[1]")
    words = F.when(kind == 1, '"one two"').when(kind == 2, "[]").when(kind == 3, '{"a": 1}').otherwise(F.concat(F.lit("["), n, F.lit(', "x"]')))
    body = F.concat(F.lit('{"role": "'), "role", F.lit('", "size": '), size, F.lit(', "words": '), words, F.lit(', "said": '), F.to_json(F.array("said")), F.when(F.col("n") % 7 == 6, "").otherwise("}"))
    fields = [extraction.ReplyField("role"), extraction.ReplyField("size", "number"), extraction.ReplyField("words", "array"), extraction.ReplyField("said")]
    found = extraction.validate_replies(rows.withColumn("reply", body), fields)
    x = F.col("extracted")
    return found.select(
        "conv_id", "turn", x["role"]["value"].alias("role"), x["size"]["number"].alias("size"), x["size"]["confidence"].alias("size_confidence"),
        x["words"]["confidence"].alias("words_confidence"), F.md5(x["said"]["value"]).alias("said_md5"), "matched", "match_rate",
    )


def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    reply = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"answer":"'), F.col("role"), F.lit('"}'))).otherwise(F.col("role"))
    return providers.answers(rows.select("conv_id", "turn", reply.alias("reply"))).select("conv_id", "turn", "answer", "confidence")


def translate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.translate(_docs(spark, sf_dir), "en", "en").select("doc_id", F.md5("translated_text").alias("text_md5"))


def sentiment_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.sentiment(_docs(spark, sf_dir)).select("doc_id", "sentiment.polarity", "sentiment.score", "sentiment.confidence", "summary")


def semantic_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda prompt: F.concat(F.lit('```\n{"size":{"value":"'), F.char_length(prompt).cast("string"), F.lit('"},"name":{"value":null}}\n```'))
    rows = providers.semantic_extract(_docs(spark, sf_dir), ["size", "name"], said)
    return rows.select("doc_id", F.col("extracted")["size"]["value"].alias("size"), F.col("extracted")["size"]["confidence"].alias("confidence"), F.col("extracted")["name"]["found"].alias("found"))


def summarize_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.summarize(load(spark, sf_dir, "benchmark"), "executive").select("item_id", "summary")


def ocr_line_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "conversations").withColumn("confidence", (F.col("turn") % 7) / 10)
    return corpus.ocr_summary(lines, ["conv_id"], "turn").withColumn("text", F.md5("text"))


def element_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.element_summary(load(spark, sf_dir, "conversations"), [], "role", {"user": "Title", "assistant": "Table"})


_NAMES = (
    "splitter_chunks splitter_stats index_chunks_trimmed clean_text clean_upper strip_special_stats digit_fold dates_numeric_normalized "
    "date_format_variants dates_by_month_name dates_relative pii_emails pii_ipv4 pii_email_offsets pii_spans_by_type pii_cards pii_phones mask_text clean_stats gap_missing spell_merge spell_documents mask_emails regex_extract_fields "
    "regex_extract_stats gap_score gap_report gap_invoices language_rank language_segments language_model_rank language_model_segments claim_split line_overlap doc_compare spell_corrections "
    "span_box_union chunks_without_emails edit_distance llm_json_recovery typed_extract answer_parse translate_identity sentiment_defaults semantic_extract summarize_first ocr_line_aggregate element_type_summary"
)
QUERIES = {n: globals()[n] for n in _NAMES.split()}
