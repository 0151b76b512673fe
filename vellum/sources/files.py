"""Files as rows: text, CSV, DOCX, XLSX; PDF where a library is installed. Only the standard library is needed otherwise.

``read_files`` lists bytes; ``parse_documents`` turns them into one row each, with its status and error, so that a bad file never
fails a corpus. Zip members are checked for size before they are read.
"""

from __future__ import annotations

import csv
import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import extension

MAX_BYTES = 50 * 1024 * 1024
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "latin-1")
DELIMITERS = ",;\t|"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = (
    "text string, blocks array<struct<kind:string,part:string,text:string,cells:array<array<string>>>>, "
    "row_count long, truncated boolean, status string, error string"
)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content, extension of the files below a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return rows.withColumn("extension", extension(F.col("path")))


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("unknown encoding")


def sniff(text: str) -> str:
    """The delimiter that splits the first lines most evenly; a comma if none does."""
    lines = [x for x in text[:4096].splitlines() if x][:20]
    scored = [(min(x.count(d) for x in lines), -i, d) for i, d in enumerate(DELIMITERS)] if lines else []
    best = max(scored, default=(0, 0, ","))
    return best[2] if best[0] else ","


def _member(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in archive.namelist():
        return None
    if archive.getinfo(name).file_size > 8 * MAX_BYTES:
        raise ValueError("archive member too large")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:1024] or b"<!ENTITY" in data:
        raise ValueError("document types are not read")
    return ElementTree.fromstring(data)


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _docx_blocks(root: ElementTree.Element, part: str) -> Iterator[dict]:
    for node in root:
        if node.tag == f"{_W}p" and (text := _paragraph(node)).strip():
            yield {"kind": "paragraph", "part": part, "text": text, "cells": None}
        elif node.tag == f"{_W}tbl":
            cells = [["\n".join(_paragraph(p) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            yield {"kind": "table", "part": part, "text": "\n".join("\t".join(r) for r in cells), "cells": cells}


def parse_docx(data: bytes, include_tables: bool = True, include_headers_footers: bool = True) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        document = _member(z, "word/document.xml")
        if document is None:
            raise ValueError("not a DOCX file")
        blocks = list(_docx_blocks(document.find(f"{_W}body"), "body"))
        if include_headers_footers:
            for kind in ("header", "footer"):
                found = {}
                for name in sorted(n for n in z.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", n)):
                    for b in _docx_blocks(_member(z, name), kind):
                        found.setdefault(b["text"], b)
                blocks = [*found.values(), *blocks] if kind == "header" else [*blocks, *found.values()]
    if not include_tables:
        blocks = [b for b in blocks if b["kind"] != "table"]
    return {"blocks": blocks, "text": "\n".join(b["text"] for b in blocks), "row_count": None, "truncated": False}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes, sheet: str | None = None, max_rows: int | None = None) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _member(z, "xl/workbook.xml")
        if book is None:
            raise ValueError("not an XLSX file")
        rels = {r.get("Id"): r.get("Target") for r in (_member(z, "xl/_rels/workbook.xml.rels") or [])}
        shared_root = _member(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared_root] if shared_root is not None else []
        sheets = [(s.get("name"), rels.get(s.get(f"{_R}id"), "")) for s in book.iter(f"{_S}sheet")]
        if sheet is not None:
            sheets = [s for s in sheets if s[0] == sheet]
            if not sheets:
                raise ValueError(f"sheet {sheet!r} not found")
        blocks, count, truncated = [], 0, False
        for name, target in sheets:
            root = _member(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            cells: list[list[str]] = []
            for row in [] if root is None else root.iter(f"{_S}row"):
                values: list[str] = []
                for i, c in enumerate(row.iter(f"{_S}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    values += [""] * (at + 1 - len(values))
                    v = c.find(f"{_S}v")
                    if c.get("t") == "s" and v is not None:
                        values[at] = shared[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        values[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is not None:
                        values[at] = {"0": "False", "1": "True"}.get(v.text, v.text) if c.get("t") == "b" else v.text or ""
                while values and not values[-1]:
                    values.pop()
                if values:
                    if max_rows is not None and len(cells) >= max_rows:
                        truncated = True
                        break
                    cells.append(values)
            count += len(cells)
            blocks.append({"kind": "sheet", "part": name, "text": f"[{name}]\n" + "\n".join("\t".join(r) for r in cells), "cells": cells})
    return {"blocks": blocks, "text": "\n\n".join(b["text"] for b in blocks), "row_count": count, "truncated": truncated}


def parse_csv(data: bytes, max_rows: int | None = None) -> dict:
    text = decode(data)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sniff(text))]
    cut = max_rows is not None and len(rows) > max_rows
    rows = rows[:max_rows] if cut else rows
    block = {"kind": "table", "part": "body", "text": "\n".join("\t".join(r) for r in rows), "cells": rows}
    return {"blocks": [block], "text": block["text"], "row_count": len(rows), "truncated": cut}


def parse_pdf(data: bytes) -> dict:
    from pypdf import PdfReader

    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    blocks = [{"kind": "page", "part": str(i), "text": t, "cells": None} for i, t in enumerate(pages, 1)]
    return {"blocks": blocks, "text": "\n".join(f"--- Page {i} ---\n{t}" for i, t in enumerate(pages, 1)), "row_count": None, "truncated": False}


def capabilities() -> dict[str, bool]:
    """What this installation can do beyond the standard library; nothing missing is hidden."""
    needs = {"pdf": "pypdf", "ocr": "pytesseract", "paddle-ocr": "paddleocr", "handwriting-ocr": "easyocr", "barcode": "pyzbar", "inpaint": "cv2", "translation": "argostranslate"}
    return {k: importlib.util.find_spec(m) is not None for k, m in needs.items()} | {"docx": True, "xlsx": True, "csv": True, "txt": True}


def parse_documents(
    files: DataFrame,
    parse_entire_document: bool = True,
    include_tables: bool = True,
    include_headers_footers: bool = True,
    sheet_name: str | None = None,
    max_rows_per_sheet: int = 5000,
    max_file_size_mb: float = 50,
    content: str = "content",
    ext: str = "extension",
) -> DataFrame:
    """``files`` (binary content and extension) with text, blocks, row_count, truncated, status and error; content is left out."""
    limit = None if parse_entire_document else max_rows_per_sheet
    max_bytes = int(max_file_size_mb * 1024 * 1024)

    def one(data: bytes | None, kind: str) -> dict:
        if data is None or not len(data):
            raise ValueError("empty file")
        if len(data) > max_bytes:
            raise ValueError("file too large")
        if kind in (".txt", ".md"):
            text = decode(data)
            return {"text": text, "blocks": [{"kind": "text", "part": "body", "text": text, "cells": None}], "row_count": None, "truncated": False}
        if kind == ".csv":
            return parse_csv(data, limit)
        if kind == ".docx":
            return parse_docx(data, include_tables, include_headers_footers)
        if kind in (".xlsx", ".xlsm"):
            return parse_xlsx(data, sheet_name, limit)
        if kind == ".pdf":
            return parse_pdf(data)
        raise ValueError(f"format {kind} is not parsed")

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in re.split(r", (?=\w+ (?:string|array|long|boolean))", SCHEMA)]
        for contents, kinds in parts:
            rows = []
            for data, kind in zip(contents, kinds, strict=True):
                try:
                    rows.append(one(data, kind) | {"status": "success", "error": None})
                except (ValueError, KeyError, ImportError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as x:
                    rows.append({"status": "failure", "error": str(x)})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    keep = [c for c in files.columns if c != content]
    return files.withColumn("_p", run(content, ext)).select(*keep, "_p.*")


def table_long(parsed: DataFrame, key: str = "path") -> DataFrame:
    """key, part, row, column, value: the cells of all tables and sheets; ragged rows stay ragged."""
    blocks = parsed.select(key, F.explode("blocks").alias("b")).where("b.cells IS NOT NULL")
    rows = blocks.select(key, F.col("b.part").alias("part"), F.posexplode("b.cells").alias("row", "cells"))
    return rows.select(key, "part", "row", F.posexplode("cells").alias("column", "value"))


def csv_delimiter(head: Column) -> Column:
    """The delimiter sniffed natively from the first line."""
    line = F.split_part(F.substring(head, 1, 4096), F.lit("\n"), F.lit(1))
    counts = F.array(*[F.struct((F.char_length(line) - F.char_length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def save_value(df: DataFrame, folder: str, key: str) -> None:
    """A key-value store on any file system: one folder for each key."""
    df.write.mode("overwrite").parquet(f"{folder}/key={key}")


def read_value(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/key={key}")


def list_keys(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(n[4:] for n in names if n.startswith("key=" + prefix))


def delete_value(spark: SparkSession, folder: str, key: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/key={key}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
