"""Document libraries: validation, corpora, merging, routing, batches, feedback and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import extension, is_blank

#: Allowed extensions by entry point, MIME types, layout element names and routing defaults.
UPLOAD_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".txt", ".png", ".jpg", ".jpeg"]
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".csv": "text/csv",
    ".txt": "text/plain",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
}
OCTETS = "application/octet-stream"
DEFAULT_ROUTE = "ocr"
FEEDBACK_CATEGORIES = ["wrong_answer", "incomplete", "irrelevant", "hallucination", "other"]


def mime_type(path: Column) -> Column:
    out = F.lit(OCTETS)
    for ext, mime in MIME_TYPES.items():
        out = F.when(extension(path) == ext, F.lit(mime)).otherwise(out)
    return out


def upload_error(path: str, size: str, allowed: list[str] | None = None, max_mb: float = 50) -> Column:
    """Why a file isn't taken; null if it is."""
    ext = extension(F.col(path))
    return (
        F.when(~ext.isin(*(allowed or UPLOAD_EXTENSIONS)), F.concat(F.lit("extension not allowed: "), ext))
        .when(F.col(size) == 0, "empty file")
        .when(F.col(size) > int(max_mb * 1024 * 1024), "file too large")
    )


def validate_uploads(files: DataFrame, path: str = "path", size: str = "size_bytes", allowed: list[str] | None = None, max_mb: float = 50) -> DataFrame:
    """``files`` with extension, mime_type, valid and error; a bad row never fails the others. Narrow."""
    error = upload_error(path, size, allowed, max_mb)
    return files.withColumns({"extension": extension(F.col(path)), "mime_type": mime_type(F.col(path)), "error": error}).withColumn("valid", F.col("error").isNull())


def validate_batch(files: DataFrame, batch: str, **options) -> DataFrame:
    """batch, document_count, failed, accepted: all or nothing, as a strict batch upload has it."""
    rows = validate_uploads(files, **options)
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("document_count"), F.count_if(~F.col("valid")).alias("failed"), F.bool_and("valid").alias("accepted"))


def build_corpus(given: DataFrame, index: DataFrame, wanted: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(documents, missing): the given documents, and those of ``wanted`` ids that the index has; ids that nothing has."""
    new = wanted.select(key).distinct().join(given.select(key), key, "left_anti")
    found = new.join(index, key)
    return given.unionByName(found, allowMissingColumns=True), new.join(index.select(key), key, "left_anti")


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order (ascending, nulls first). Summed up before it moves, so a hot key is no burden."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, F.struct(*order)).alias("_best"))
    return best.select("_best.*")


def corpus_stats(documents: DataFrame, by: list[str], size: str, ext: str) -> DataFrame:
    """by, document_count, total_size_bytes, extensions (sorted, joined by commas)."""
    return documents.groupBy(*by).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.sum(size).alias("total_size_bytes"),
        F.array_join(F.array_sort(F.collect_set(ext)), ",").alias("extensions"),
    )


def upsert_latest(old: DataFrame, new: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The library after a merge: for each key the row with the latest time, then the greatest tie-breaker."""
    rows = old.unionByName(new)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.struct(at, tie)).alias("_best")).select("_best.*")


def reconcile(index: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """key and state: kept, adopted (a file that the index lacks) or dropped (its file is gone)."""
    joined = index.select(F.col(key).alias("a")).join(listing.select(F.col(key).alias("b")), F.col("a") == F.col("b"), "full")
    state = F.when(F.col("b").isNull(), "dropped").when(F.col("a").isNull(), "adopted").otherwise("kept")
    return joined.select(F.coalesce("a", "b").alias(key), state.alias("state"))


def route(rows: DataFrame, path: str, rules: list[tuple[str, list[str]]], default: str = DEFAULT_ROUTE) -> DataFrame:
    """``rows`` with route: the first rule whose extensions hold the file's, and confidence. Branches are filters on it."""
    ext, out = extension(F.col(path)), F.lit(default)
    for name, exts in reversed(rules):
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return rows.withColumn("route", out).withColumn("confidence", F.lit(1.0))


def validate_feedback(rows: DataFrame, sentiment: str = "sentiment", correction: str = "correction") -> DataFrame:
    """``rows`` with valid, signal (1, -1 or 0) and error: negative feedback needs a correction. Narrow."""
    kind = F.lower(F.trim(F.col(sentiment)))
    error = F.when(~F.coalesce(kind.isin("positive", "negative"), F.lit(False)), "unknown sentiment").when(
        (kind == "negative") & is_blank(F.col(correction)), "correction required"
    )
    signal = F.when(error.isNotNull(), 0).when(kind == "positive", 1).otherwise(-1)
    return rows.withColumns({"error": error, "signal": signal}).withColumn("valid", F.col("error").isNull())


def append_feedback(rows: DataFrame, folder: str, at: str = "timestamp") -> None:
    """Appends JSON lines, one folder for each UTC day."""
    rows.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(folder)


def ocr_summary(lines: DataFrame, page: list[str], order: str, text: str = "text", confidence: str = "confidence", joiner: str = "\n") -> DataFrame:
    """page, text (lines that aren't blank, joined), total_lines, avg_confidence (4 decimals), total_chars."""
    kept = lines.where(~is_blank(F.col(text)))
    listed = kept.groupBy(*page).agg(
        F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("l"), F.round(F.avg(confidence), 4).alias("avg_confidence")
    )
    joined = F.array_join(F.transform("l", lambda x: x.t), joiner)
    return listed.select(*page, joined.alias("text"), F.size("l").cast("long").alias("total_lines"), "avg_confidence", F.char_length(joined).cast("long").alias("total_chars"))


#: Layout categories by the partitioner's names.
ELEMENT_TYPES = {
    "Title": "Title",
    "NarrativeText": "Text",
    "UncategorizedText": "Text",
    "ListItem": "List",
    "Table": "Table",
    "Image": "Figure",
    "Figure": "Figure",
    "FigureCaption": "Caption",
    "Header": "Header",
    "Footer": "Footer",
    "PageBreak": "PageBreak",
    "Address": "Text",
    "EmailAddress": "Text",
    "Formula": "Formula",
    "CodeSnippet": "Code",
}


def element_summary(elements: DataFrame, by: list[str], kind: str, names: dict[str, str] | None = None, default: str = "Text") -> DataFrame:
    """by, element_type, elements, words: layout elements counted by mapped type."""
    table = F.create_map(*[F.lit(x) for pair in (names or ELEMENT_TYPES).items() for x in pair])
    mapped = F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(default))
    words = F.size(F.filter(F.split("text", r"(?U)\s+", -1), lambda w: w != ""))
    return elements.groupBy(*by, mapped.alias("element_type")).agg(F.count(F.lit(1)).alias("elements"), F.sum(words).alias("words"))


def table_counts(labels: Column) -> Column:
    """(rows, columns) from detected labels: a label counts as what it names, so a column header is a column."""
    return F.struct(
        F.size(F.filter(labels, lambda x: F.contains(x, F.lit("row")))).alias("rows"),
        F.size(F.filter(labels, lambda x: F.contains(x, F.lit("column")))).alias("columns"),
    )
