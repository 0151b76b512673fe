"""Sinks: rows as text, JSON lines or CSV in a folder; small reports as one ZIP file."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report holds at most; larger results belong into a folder.
REPORT_ROWS = 100_000


def write_rows(df: DataFrame, folder: str, kind: str = "json", mode: str = "error") -> None:
    """``df`` as "json" (lines), "csv" (nested columns as JSON) or "text" (its one string column)."""
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).csv(folder)
    elif kind == "text":
        df.write.mode(mode).text(folder)
    else:
        df.write.mode(mode).json(folder)


def report_zip(**tables: DataFrame) -> bytes:
    """A ZIP file with one JSON-lines member for each table; a table of over REPORT_ROWS rows is refused, not cut."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            rows = df.limit(REPORT_ROWS + 1).toJSON().collect()
            if len(rows) > REPORT_ROWS:
                raise ValueError(f"{name} has over {REPORT_ROWS} rows; write it to a folder")
            z.writestr(f"{name}.jsonl", "".join(r + "\n" for r in rows))
    return out.getvalue()


def download(name: str, path: str, mime_type: str, size_bytes: int) -> dict:
    """What a caller is told about a file that was written."""
    return {"filename": name, "path": path, "download_url": f"/downloads/{name}", "mime_type": mime_type, "size_bytes": size_bytes}


def report_json(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, default=str)
