"""Rows that fail by themselves, and what a run observes."""

from vellum.workflow.graph import Graph
from vellum.workflow.nodes import REGISTRY
from vellum.workflow.rows import outcomes, rejected, run_observed, run_rows

ROWS = [
    (1, "a.txt", 10, '{"steps": []}', "on 29/02/2020"),
    (2, "b.exe", 10, '{"steps": []}', "x"),
    (3, "c.txt", 10, '```json\n{"steps": [{"agent": "a", "instruction": "b"}]}\n```', "31/04/2021 and 1/1/2020"),
    (4, "d.txt", 10, '{"steps": [', "x"),
    (5, "e.txt", 2_000_000, None, "x"),
    (6, None, 10, "{}", "x"),
    (7, "g.txt", 10, None, " \n"),
    (8, "h.txt", 10, "{}", " \n"),
    (8, "h.txt", 0, "{}", "fine"),
    (None, "i.txt", 10, "{}", "fine"),
    (None, "i.exe", 10, "{}", "fine"),
]
SUB = {
    "nodes": [
        {"id": "up", "type": "document-upload", "config": {"max_file_size_mb": 1}},
        {"id": "plan", "type": "router-agent"},
        {"id": "dates", "type": "date-normalizer", "config": {"strict": True}},
        {"id": "split", "type": "text-splitter"},
    ],
    "edges": [
        {"source": "up", "source_port": "document", "target": "plan", "target_port": "plan"},
        {"source": "plan", "source_port": "steps", "target": "dates", "target_port": "text"},
        {"source": "dates", "source_port": "text", "target": "split", "target_port": "text"},
    ],
}


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, path string, size_bytes long, reply string, text string")


def test_each_row_has_its_outcome(spark):
    docs = table(spark)
    runs = run_rows(Graph.from_dict(SUB), REGISTRY, docs)
    got = sorted(((r.doc_id, r.status, r.node, r.error) for r in outcomes(runs, docs).collect()), key=str)
    want = [
        (1, "success", None, None),
        (2, "failure", "up", "extension not allowed: .exe"),
        (3, "failure", "dates", "no such date: 31/04/2021"),
        (4, "failure", "plan", "reply is no JSON"),
        (5, "failure", "up", "file too large"),
        (6, "failure", "up", "no path or size"),
        (7, "failure", "plan", "reply is no JSON"),
        (8, "failure", "up", "empty file"),
        (8, "failure", "up", "empty file"),
        (None, "failure", "up", "extension not allowed: .exe"),
        (None, "failure", "up", "extension not allowed: .exe"),
    ]
    assert got == sorted(want, key=str)
    assert {r.text for r in runs["split"].outputs["chunks"].collect()} == {"on 2020-02-29", "fine"}
    assert rejected(runs, docs).where("node = 'split'").count() == 1
    out = REGISTRY["for-each"].run({"documents": docs}, {"subgraph": SUB, "key": "doc_id"})
    assert out["results"].where("status = 'success'").count() == 1 and out["rejected"].count() == 9
    assert REGISTRY["for-each"].run({"documents": docs}, {})["results"] is docs


def test_a_node_that_cannot_be_planned_rejects_its_rows(spark):
    docs = table(spark)
    sub = {"nodes": [SUB["nodes"][0], {"id": "codes", "type": "barcode-reader"}], "edges": [{"source": "up", "source_port": "document", "target": "codes", "target_port": "image"}]}
    runs = run_rows(Graph.from_dict(sub), REGISTRY, docs)
    assert runs["codes"].status == "failure"
    rows = {(r.doc_id, r.node) for r in outcomes(runs, docs).collect()}
    assert (1, "codes") in rows and (2, "up") in rows and not [n for _, n in rows if n is None]


def test_a_run_observes_its_rows(spark):
    seen = {r["node"]: r for r in run_observed(Graph.from_dict(SUB), REGISTRY, table(spark).repartition(3))}
    told = {n: (r["rows_in"], r["failed"], r["rows_out"]) for n, r in seen.items()}
    assert told == {"up": (11, 5, 6), "plan": (6, 2, 4), "dates": (4, 1, 3), "split": (3, 1, 2)}
    assert all(r["status"] == "success" and r["run_ms"] > 0 for r in seen.values())
    none = run_observed(Graph.from_dict(SUB), REGISTRY, table(spark, []))
    assert all(r["rows_in"] in (0, None) for r in none)
