"""Failures of single rows, and what a run has counted.

A graph runs over whole relations, but a row can fail by itself: a file that is too large, JSON that isn't, a date that no calendar has.
Each node type says in ``CHECKS`` what it can't take, as a Column that is an error text or null, in functions that never throw. Before a
node its input is split by that: good rows go on, the others go to one relation of rejected rows with the node and the error. So a bad row never
fails a run, and every document ends with one outcome. A node that can't be planned at all rejects whatever reaches it.

What a run counts is observed while it runs (rows in, rows out, failures for each node), by one action for each end of the graph; nothing is
read for it a second time.

Edge cases: a key that is there several times fails as a whole if one of its rows fails; rows without a key share one. Nodes without a check take every row.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vellum.functions.jsontext import json_text
from vellum.functions.text import is_blank
from vellum.operators import corpus
from vellum.workflow.graph import Graph, NodeType, Port

Check = Callable[[DataFrame, dict[str, Any]], Column]


def _missing(df: DataFrame, name: str) -> Column | None:
    return None if name in df.columns else F.lit(f"no column {name}")


def not_blank(name: str) -> Check:
    return lambda df, _: _missing(df, name) if name not in df.columns else F.when(is_blank(F.col(name)), f"{name} is blank")


def is_json(name: str) -> Check:
    """The JSON that a text holds, fenced or not, has to parse."""
    return lambda df, _: _missing(df, name) if name not in df.columns else F.when(F.try_parse_json(json_text(F.col(name))).isNull(), f"{name} is no JSON")


def is_number(name: str) -> Check:
    return lambda df, c: F.when(F.col(c.get("column") or name).try_cast("double").isNull(), "not a number")


def calendar_dates(df: DataFrame, config: dict[str, Any]) -> Column:
    """With ``strict``: day/month/year with four digits has to be a day of the calendar."""
    found = F.regexp_extract_all("text", F.lit(r"(?<!\d)\d{1,2}/\d{1,2}/\d{4}(?!\d)"), F.lit(0))
    wrong = F.filter(found, lambda d: F.try_to_timestamp(d, F.lit("d/M/yyyy")).isNull())
    return F.when(F.lit(bool(config.get("strict"))) & (F.size(wrong) > 0), F.concat(F.lit("no such date: "), F.get(wrong, F.lit(0))))


def uploads(df: DataFrame, config: dict[str, Any]) -> Column:
    checked = corpus.upload_error("path", "size_bytes", max_mb=float(config.get("max_file_size_mb") or 50))
    return F.when(F.col("path").isNull() | F.col("size_bytes").isNull(), "no path or size").otherwise(checked)


#: What node types can't take, by their type.
CHECKS: dict[str, Check] = {
    "document-upload": uploads,
    "document-batch-upload": uploads,
    "date-normalizer": calendar_dates,
    "text-splitter": not_blank("text"),
    "embedding-node": not_blank("text"),
    "prompt-builder": not_blank("question"),
    "router-agent": is_json("reply"),
    "table-agent": is_number("value"),
}


@dataclass
class RowRun:
    """A node: its status, its outputs, what was rejected before it, and what a run has observed."""

    node: str
    level: int
    status: str
    error: str | None
    outputs: dict[str, DataFrame]
    rejected: list[DataFrame]
    plan_ms: float
    seen: dict[str, Observation] = field(default_factory=dict)


def run_rows(graph: Graph, registry: dict[str, NodeType], documents: DataFrame, key: str = "doc_id", port: str | None = None, observe: bool = False) -> dict[str, RowRun]:
    """The graph over ``documents``, which go to every root. Lazy; with ``observe`` its relations count their rows when they run."""
    runs: dict[str, RowRun] = {}
    for level, names in enumerate(graph.levels()):
        for name in names:
            kind, began = registry[graph.nodes[name].type], perf_counter()
            config = kind.config(graph.nodes[name].config)
            given = {e.target_port: runs[e.source].outputs[e.source_port] for e in graph.edges if e.target == name and e.kind == "data" and e.source_port in runs[e.source].outputs}
            if not any(e.target == name and e.kind == "data" for e in graph.edges):
                given = {port or (kind.inputs or (Port("input"),))[0].name: documents}
            run = RowRun(name, level, "success", None, {}, [], 0.0)
            good = {}
            for p, df in given.items():
                error = CHECKS[graph.nodes[name].type](df, config) if graph.nodes[name].type in CHECKS else F.lit(None).cast("string")
                marked = df.withColumn("_row_error", error)
                if observe:
                    run.seen[f"in:{p}"] = Observation(f"{name} in {p}")
                    marked = marked.observe(run.seen[f"in:{p}"], F.count(F.lit(1)).alias("rows"), F.count("_row_error").alias("failed"))
                good[p] = marked.where("_row_error IS NULL").drop("_row_error")
                if graph.nodes[name].type in CHECKS:
                    bad = df.withColumn("_row_error", error).where("_row_error IS NOT NULL")
                    run.rejected.append(bad.select(F.col(key), F.lit(level).alias("level"), F.lit(name).alias("node"), F.col("_row_error").alias("error")))
            try:
                run.outputs = dict(kind.run(good, config))
            except (ValueError, KeyError, RuntimeError) as x:
                run.status, run.error = "failure", str(x)
                reached = next(iter(good.values()), None)
                if reached is not None:
                    run.rejected.append(reached.select(F.col(key), F.lit(level).alias("level"), F.lit(name).alias("node"), F.lit(str(x)).alias("error")))
            if observe:
                for p, df in list(run.outputs.items()):
                    run.seen[f"out:{p}"] = Observation(f"{name} out {p}")
                    run.outputs[p] = df.observe(run.seen[f"out:{p}"], F.count(F.lit(1)).alias("rows"))
            run.plan_ms = 1000 * (perf_counter() - began)
            runs[name] = run
    return runs


def rejected(runs: dict[str, RowRun], documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level, node, error): each row that a node rejected."""
    kind = documents.schema[key].dataType.simpleString()
    out = documents.sparkSession.createDataFrame([], f"`{key}` {kind}, level int, node string, error string")
    for part in (r for run in runs.values() for r in run.rejected):
        out = out.unionByName(part)
    return out


def outcomes(runs: dict[str, RowRun], documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, node, error) for each row of ``documents``: the first node that rejected it, by level and name."""
    first = rejected(runs, documents, key).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("level", "node", "error")).alias("_first"))
    met = documents.select(key).join(first, F.col(key).eqNullSafe(F.col("_k")), "left")
    return met.select(key, F.when(F.col("_first").isNull(), "success").otherwise("failure").alias("status"), F.col("_first.node").alias("node"), F.col("_first.error").alias("error"))


def _counts(seen: Observation | None, wait: float = 20.0) -> dict[str, int]:
    """What an observation holds; nothing if its part of the plan has been optimised away."""
    out: dict[str, int] = {}
    if seen is not None:
        asked = threading.Thread(target=lambda: out.update(seen.get), daemon=True)
        asked.start()
        asked.join(wait)
    return out


def run_observed(graph: Graph, registry: dict[str, NodeType], documents: DataFrame, key: str = "doc_id", port: str | None = None) -> list[dict[str, Any]]:
    """Runs the graph to all its ends and returns, for each node: node, level, status, error, rows_in, rows_out, failed, plan_ms, run_ms.

    ``rows_out`` counts the first output that an end of the graph reads; ``run_ms`` is the time of the action that first ran the node.
    """
    runs = run_rows(graph, registry, documents, key, port, observe=True)
    read = {(e.source, e.source_port) for e in graph.edges if e.kind == "data"}
    ends = [(n, p) for n, run in runs.items() for p in run.outputs if (n, p) not in read and not any(s == n for s, _ in read)]
    ends = [e for i, e in enumerate(ends) if e[0] not in {n for n, _ in ends[:i]}]  # one output of each last node
    took: dict[str, float] = {}
    for n, p in ends:
        began = perf_counter()
        runs[n].outputs[p].write.format("noop").mode("overwrite").save()
        spent = 1000 * (perf_counter() - began)
        for name in [n, *(x for x, _, _ in graph.lineage(n))]:
            took.setdefault(name, spent)
    out = []
    for name, run in runs.items():
        used = [s for k, s in run.seen.items() if k.startswith("in:")] if name in took else []
        ports = [p for n, p in ends if n == name] or sorted(p for n, p in read if n == name)
        came, went = _counts(used[0] if used else None), _counts(run.seen.get(f"out:{ports[0]}") if ports and name in took else None)
        out.append({"node": name, "level": run.level, "status": run.status, "error": run.error, "rows_in": came.get("rows"), "rows_out": went.get("rows"), "failed": came.get("failed"), "plan_ms": run.plan_ms, "run_ms": took.get(name)})
    return out
