import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import network
from vellum.operators import corpus
from vellum.sources import sinks
from vellum.workflow.graph import compose
from vellum.workflow.nodes import REGISTRY
from vellum.workflow.templates import TEMPLATES


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates_fit(name):
    graph = TEMPLATES[name]()
    roots = [e for e in graph.validate(REGISTRY, "relaxed") if "is required" not in e]
    assert roots == [] and graph.levels()


def test_routed_files_are_parsed(spark):
    rows = [("a.txt", b"x  y"), ("b.png", b"\x89"), ("c.csv", b"1;2\n")]
    files = spark.createDataFrame([(p, p[1:], bytearray(b)) for p, b in rows], "path string, extension string, content binary")
    runs = compose(TEMPLATES["routing"](), REGISTRY, {"route": {"document": files}}, mode="off")
    out = {r.path: r.text for r in runs["clean"].outputs["text"].collect()}
    assert out == {"a.txt": "x y", "c.csv": "1 2"}


def test_rag_template(spark):
    docs = spark.createDataFrame([(1, "red  apples grow on trees"), (2, "the sea is deep")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "apples on trees")], "query_id long, question string")
    runs = compose(TEMPLATES["rag"](1), REGISTRY, {"clean": {"text": docs}, "ask": {"question": asked}}, mode="off")
    assert runs["ask"].outputs["retrieved_chunks"].first().retrieved[0].text == "red apples grow on trees"


def test_network(spark):
    urls = {
        "http://example.com/x": False,
        "https://10.0.0.1/": True,
        "http://172.20.1.1": True,
        "http://172.32.1.1": False,
        "http://user@localhost:80/": True,
        "http://[::1]/": True,
        "http://169.254.1.1": True,
        "http://8.8.8.8/": False,
        "http://1.2.3": True,
        "ftp://example.com": True,
    }
    df = spark.createDataFrame(list(urls.items()), "url string, blocked boolean")
    assert df.where(network.is_blocked_host(network.host(F.col("url"))) != F.col("blocked")).collect() == []
    ips = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("01.1.1.1",), ("1.2.3",), (None,)], "v string")
    assert [r[0] for r in ips.select(network.is_ipv4(F.col("v"))).collect()] == [True, False, False, False, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "i int, l array<string>")
    for kind in ("json", "csv"):
        sinks.write_rows(df, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").where("i = 1").first().l == '["a"]'
    with zipfile.ZipFile(io.BytesIO(sinks.report_zip(rows=df))) as z:
        assert z.read("rows.jsonl").decode().count("\n") == 2


def test_feedback_log(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "positive"), ("2024-01-02 10:00:00", "negative")], "timestamp string, sentiment string")
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    folder = f"file://{tmp_path}/log"
    for _ in range(2):
        corpus.append_feedback(rows, folder)
    assert spark.read.json(folder).groupBy("date").count().where("count = 2").count() == 2
