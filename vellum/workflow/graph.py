"""Workflow graphs: nodes and edges, validated, put in levels, and composed into lazy DataFrames.

The driver walks the graph once; nothing runs until a sink does. Each output is planned once and shared. Decisions, recorded here:

* A node whose input failed to plan still gets planned, with that input missing, as long as it isn't required.
* Port types and required inputs are checked when mode is "strict" or "relaxed"; "off" checks nothing. Orphans are errors in
  strict mode only.
* Of several edges into one port the later one wins for each whole relation (rows are not mixed).
* A control edge filters: its target sees the rows whose ``route`` is the edge's condition. Rows of several edges are united.
* A for-each is no loop: its subgraph is applied to the whole relation.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PORT_TYPES = ("document", "document[]", "text", "embedding", "chunks", "table", "image", "corpus", "json", "any")
#: What a source's type may connect to, besides itself and "any".
COMPATIBLE = {
    "document": {"document[]", "image"},
    "document[]": set(),
    "image": {"document"},
    "text": {"chunks"},
    "chunks": {"text"},
    "any": set(PORT_TYPES),
}
FIELD_TYPES = ("text", "number", "select", "boolean", "file", "json", "password", "secret", "slider", "tags")


def compatible(source: str, target: str) -> bool:
    return target in {source, "any"} | COMPATIBLE.get(source, set())


@dataclass(frozen=True)
class Port:
    name: str
    type: str = "any"
    required: bool = True


@dataclass(frozen=True)
class ConfigField:
    key: str
    type: str = "text"
    required: bool = False
    default: Any = None
    options: tuple = ()


@dataclass(frozen=True)
class NodeType:
    """An operator: run(inputs by port, config) -> outputs by port."""

    type: str
    category: str
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]
    run: Callable[[dict[str, DataFrame], dict[str, Any]], dict[str, DataFrame]]
    fields: tuple[ConfigField, ...] = ()
    requires: str | None = None

    def config(self, given: dict[str, Any]) -> dict[str, Any]:
        """Given values over defaults; None is dropped. Raises ValueError for what isn't valid."""
        out = {f.key: given.get(f.key) if given.get(f.key) is not None else f.default for f in self.fields}
        for f in self.fields:
            value = out[f.key]
            if value is None:
                if f.required:
                    raise ValueError(f"{self.type}: {f.key} is required")
                del out[f.key]
            elif f.type == "select" and f.options and value not in f.options:
                raise ValueError(f"{self.type}: {f.key} must be one of {', '.join(map(str, f.options))}")
            elif f.type in ("number", "slider"):
                try:
                    float(value)
                except (TypeError, ValueError):
                    raise ValueError(f"{self.type}: {f.key} must be a number") from None
        return out | {k: v for k, v in given.items() if k not in {f.key for f in self.fields}}


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    config: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_port: str = "output"
    target_port: str = "input"
    kind: str = "data"
    condition: str | None = None


@dataclass
class Graph:
    nodes: dict[str, Node]
    edges: list[Edge]
    id: str = "unknown"

    @classmethod
    def from_dict(cls, data: dict) -> Graph:
        """Raises ValueError for a repeated node id or an edge whose node isn't there."""
        nodes: dict[str, Node] = {}
        for n in data.get("nodes", []):
            if n["id"] in nodes:
                raise ValueError(f"node {n['id']} is there twice")
            nodes[n["id"]] = Node(n["id"], n["type"], dict(n.get("config") or {}))
        edges = [Edge(**{k: e[k] for k in ("source", "target", "source_port", "target_port", "kind", "condition") if e.get(k) is not None}) for e in data.get("edges", [])]
        for e in edges:
            if e.source not in nodes or e.target not in nodes:
                raise ValueError(f"edge {e.source} -> {e.target} has no such node")
        return cls(nodes, edges, str(data.get("id", "unknown")))

    def levels(self) -> list[list[str]]:
        """Node ids by level; a level needs only those before it. Raises ValueError for a circle."""
        left = {n: sum(e.target == n for e in self.edges) for n in self.nodes}
        out, done = [], 0
        ready = sorted(n for n, k in left.items() if not k)
        while ready:
            out.append(ready)
            done += len(ready)
            for n in ready:
                for e in self.edges:
                    if e.source == n:
                        left[e.target] -= 1
            seen = {x for level in out for x in level}
            ready = sorted(n for n, k in left.items() if not k and n not in seen)
        if done < len(self.nodes):
            raise ValueError("the workflow has a circle")
        return out

    def lineage(self, node: str, preferred: tuple[str, ...] = ()) -> list[tuple[str, str, int]]:
        """(node, port, distance) of all that lies upstream, nearest first, preferred ports before others."""
        out, seen, queue = [], {node}, deque([(node, 0)])
        while queue:
            at, d = queue.popleft()
            for e in self.edges:
                if e.target == at and e.kind == "data":
                    if (e.source, e.source_port) not in [(n, p) for n, p, _ in out]:
                        out.append((e.source, e.source_port, d + 1))
                    if e.source not in seen:
                        seen.add(e.source)
                        queue.append((e.source, d + 1))
        rank = {p: i for i, p in enumerate(preferred)}
        return sorted(out, key=lambda x: (x[2], rank.get(x[1], len(rank))))

    def validate(self, registry: dict[str, NodeType], mode: str = "strict") -> list[str]:
        if mode == "off":
            return []
        errors = [f"{n.id}: unknown type {n.type}" for n in self.nodes.values() if n.type not in registry]
        try:
            self.levels()
        except ValueError as x:
            errors.append(str(x))
        if errors:
            return errors
        for e in self.edges:
            if e.kind != "data":
                continue
            out = {p.name: p for p in registry[self.nodes[e.source].type].outputs}
            into = {p.name: p for p in registry[self.nodes[e.target].type].inputs}
            if e.source_port not in out or e.target_port not in into:
                errors.append(f"{e.source}.{e.source_port} -> {e.target}.{e.target_port}: no such port")
            elif not compatible(out[e.source_port].type, into[e.target_port].type):
                errors.append(f"{e.source}.{e.source_port} ({out[e.source_port].type}) -> {e.target}.{e.target_port} ({into[e.target_port].type}): types do not fit")
        given = {(e.target, e.target_port) for e in self.edges if e.kind == "data"}
        for n in self.nodes.values():
            errors += [f"{n.id}: input {p.name} is required" for p in registry[n.type].inputs if p.required and (n.id, p.name) not in given and p.name not in n.config]
            if mode == "strict" and len(self.nodes) > 1 and not any(n.id in (e.source, e.target) for e in self.edges):
                errors.append(f"{n.id}: is connected to nothing")
        return errors


@dataclass
class NodeRun:
    node: str
    level: int
    status: str
    error: str | None
    outputs: dict[str, DataFrame]
    plan_ms: float


def compose(graph: Graph, registry: dict[str, NodeType], inputs: dict[str, dict[str, DataFrame]] | None = None, mode: str = "relaxed") -> dict[str, NodeRun]:
    """Every node's lazy outputs. ``inputs``: relations given to nodes by port. A graph that isn't valid fails as a whole."""
    errors = graph.validate(registry, mode)
    if errors:
        return {n: NodeRun(n, 0, "failure", "; ".join(errors), {}, 0.0) for n in graph.nodes}
    runs: dict[str, NodeRun] = {}
    for level, names in enumerate(graph.levels()):
        for name in names:
            node, began = graph.nodes[name], perf_counter()
            given = dict((inputs or {}).get(name, {}))
            for e in graph.edges:
                if e.target == name and e.kind == "data" and (df := runs[e.source].outputs.get(e.source_port)) is not None:
                    given[e.target_port] = df
            control = [e for e in graph.edges if e.target == name and e.kind == "control" and runs[e.source].outputs]
            conditions = [e.condition for e in control if e.condition is not None]
            if conditions:
                given = {p: _branch(df, [runs[e.source] for e in control], conditions) for p, df in given.items()}
            kind = registry[node.type]
            try:
                if unrouted := [p for p, df in given.items() if df is None]:
                    raise ValueError(f"{name}: what comes in at {', '.join(unrouted)} can't be told by route")
                outputs = kind.run(given, kind.config(node.config))
                run = NodeRun(name, level, "success", None, outputs, 0.0)
            except (ValueError, KeyError, RuntimeError) as x:
                run = NodeRun(name, level, "failure", str(x), {}, 0.0)
            run.plan_ms = 1000 * (perf_counter() - began)
            runs[name] = run
    return runs


#: Columns by which rows that come past a router are matched with its decisions.
KEYS = ("doc_id", "file_id", "path")


def _branch(df: DataFrame, routers: list[NodeRun], conditions: list[str]) -> DataFrame | None:
    """The rows of a branch: by their own ``route``, or by that which a router gave to the rows with the same key; None if neither is there."""
    if "route" in df.columns:
        return df.where(F.col("route").isin(*conditions))
    for decided in (out for run in routers for out in run.outputs.values() if "route" in out.columns):
        key = next((k for k in KEYS if k in df.columns and k in decided.columns), None)
        if key is not None:
            return df.join(decided.where(F.col("route").isin(*conditions)).select(key), key, "left_semi")
    return None


def report(runs: dict[str, NodeRun]) -> dict[str, Any]:
    """Status counts and the whole run's status: failed if any node failed; skipped is no failure."""
    statuses = [r.status for r in runs.values()]
    return {"status": "failed" if "failure" in statuses else "success", "nodes": len(runs), **{s: statuses.count(s) for s in sorted(set(statuses))}}


def for_each(graph: Graph, registry: dict[str, NodeType], documents: DataFrame, port: str | None = None, mode: str = "off") -> dict[str, NodeRun]:
    """The subgraph over a whole relation: ``documents`` goes to every root, at ``port`` or its first input."""
    roots = [n for n in graph.nodes if not any(e.target == n and e.kind == "data" for e in graph.edges)]
    given = {n: {port or (registry[graph.nodes[n].type].inputs or (Port("input"),))[0].name: documents} for n in roots}
    return compose(graph, registry, given, mode)


def outcome_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """total, succeeded, failed."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "success").alias("succeeded"), F.count_if(F.col(status) == "failure").alias("failed")
    )
