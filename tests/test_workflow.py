import pytest

from vellum.workflow.graph import Graph, compatible, compose, for_each, report
from vellum.workflow.nodes import REGISTRY, missing_requirements


def graph(nodes, edges):
    return Graph.from_dict({"nodes": [{"id": i, "type": t, "config": c} for i, t, c in nodes], "edges": [dict(zip(("source", "source_port", "target", "target_port"), e, strict=True)) for e in edges]})


def test_ports():
    assert compatible("text", "chunks") and compatible("document", "image") and compatible("json", "any") and compatible("any", "table")
    assert not compatible("json", "text") and not compatible("document[]", "document")


def test_all_node_types_are_there():
    assert len(REGISTRY) == 42
    assert missing_requirements()["ocr-node"]


def test_bad_graphs():
    with pytest.raises(ValueError):
        graph([("a", "masker", {}), ("a", "masker", {})], [])
    with pytest.raises(ValueError):
        graph([("a", "masker", {})], [("a", "text", "b", "text")])
    circle = graph([("a", "masker", {}), ("b", "masker", {})], [("a", "text", "b", "text"), ("b", "text", "a", "text")])
    assert "circle" in circle.validate(REGISTRY)[0]
    wrong = graph([("a", "text-splitter", {}), ("b", "contrast-enhancer", {})], [("a", "chunks", "b", "image")])
    assert any("types do not fit" in e for e in wrong.validate(REGISTRY))
    assert "unknown type" in graph([("a", "nothing", {})], []).validate(REGISTRY)[0]


def test_config():
    kind = REGISTRY["text-cleaner"]
    assert kind.config({})["collapse_whitespace"] is True
    with pytest.raises(ValueError):
        kind.config({"normalize_casing": "loud"})
    with pytest.raises(ValueError):
        REGISTRY["text-splitter"].config({"chunk_size": "x"})
    with pytest.raises(ValueError):
        REGISTRY["regex-extractor"].config({})


def test_lineage():
    g = graph([("in", "document-upload", {}), ("conv", "file-converter", {}), ("parse", "document-parser", {})], [("in", "document", "conv", "document"), ("conv", "converted_path", "parse", "document")])
    assert g.lineage("parse") == [("conv", "converted_path", 1), ("in", "document", 2)]


def test_compose(spark):
    docs = spark.createDataFrame([(1, "Mail me: a@b.org " * 3)], "doc_id long, text string")
    g = graph([("in", "corpus-input", {}), ("mask", "masker", {"mask": "*"}), ("split", "text-splitter", {"chunk_size": 10, "chunk_overlap": 0}), ("ocr", "ocr-node", {})],
              [("in", "documents", "mask", "text"), ("mask", "text", "split", "text")])
    runs = compose(g, REGISTRY, {"in": {"documents": docs}, "ocr": {"document": docs}}, mode="off")
    assert runs["split"].outputs["chunks"].count() == 6 and runs["split"].level == 2
    assert "*******" in runs["mask"].outputs["text"].first().text
    assert runs["ocr"].status == "failure" and "OCR engine" in runs["ocr"].error
    assert report(runs)["status"] == "failed"


def test_control_edges(spark):
    docs = spark.createDataFrame([(1, "a.txt", "one"), (2, "b.pdf", "two")], "doc_id long, path string, text string")
    g = Graph.from_dict({
        "nodes": [{"id": "r", "type": "router", "config": {"rules": [["plain", [".txt"]]]}}, {"id": "c", "type": "text-cleaner"}],
        "edges": [{"source": "r", "source_port": "route", "target": "c", "target_port": "text"}, {"source": "r", "target": "c", "kind": "control", "condition": "plain"}],
    })
    runs = compose(g, REGISTRY, {"r": {"document": docs}}, mode="off")
    assert [r.doc_id for r in runs["c"].outputs["text"].collect()] == [1]


def test_control_edges_of_data_that_comes_past_the_router(spark):
    docs = spark.createDataFrame([(1, "a.txt", "one"), (2, "b.pdf", "two")], "doc_id long, path string, text string")
    g = Graph.from_dict({
        "nodes": [{"id": "in", "type": "corpus-input"}, {"id": "r", "type": "router", "config": {"rules": [["plain", [".txt"]]]}}, {"id": "c", "type": "text-cleaner"}],
        "edges": [
            {"source": "in", "source_port": "documents", "target": "r", "target_port": "document"},
            {"source": "in", "source_port": "documents", "target": "c", "target_port": "text"},
            {"source": "r", "target": "c", "kind": "control", "condition": "plain"},
        ],
    })
    runs = compose(g, REGISTRY, {"in": {"documents": docs}}, mode="off")
    assert [r.doc_id for r in runs["c"].outputs["text"].collect()] == [1]
    given = {"r": {"document": docs}, "c": {"text": docs.select("text")}}
    g.edges[:] = [e for e in g.edges if e.kind == "control"]
    runs = compose(g, REGISTRY, given, mode="off")
    assert runs["c"].status == "failure" and "told by route" in runs["c"].error


def test_for_each_is_the_whole_relation(spark):
    docs = spark.createDataFrame([(1, "a  b"), (2, "c\t\td")], "doc_id long, text string")
    g = graph([("clean", "text-cleaner", {})], [])
    out = for_each(g, REGISTRY, docs)["clean"].outputs["text"]
    assert sorted(r.text for r in out.collect()) == ["a b", "c d"]
