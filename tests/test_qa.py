"""Question answering: every item of the benchmark is asked of every document's chunks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import vectors
from vellum.operators import retrieval
from vellum.plans import table_queries

DOCS = [(d, " ".join(f"word{(d * w) % 37} fish{d % 4}" for w in range(1, 12 * d))) for d in range(1, 12)]
DOCS += [(20, "red apples grow on trees"), (21, "red apples grow on trees"), (22, "the sea is deep and blue"), (23, " \n "), (24, None), (25, "x" * 400 + " " * 900 + "apples"), (26, "...")]
ITEMS = [(i, f"word{i} fish{i % 4} word{i * 3 % 37}") for i in (0, 1, 2, 7, 49, 51, 99)] + [(60, "which apples are red"), (61, ""), (62, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('qa')}"
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def wanted(spark):
    """For each item its five best chunks, of all pairs: rank, text, source, score."""
    chunks = []
    for d, text in DOCS:
        cut = [(text or "")[at : at + 512].strip() for at in range(0, max(len(text or "") - 512 + 411, 1), 412)]
        chunks += [(d, i, c) for i, c in enumerate(c for c in cut if c)]
    store = spark.createDataFrame(chunks, "d long, i int, t string").withColumn("v", vectors.hashed_embedding(F.col("t")))
    asked = spark.createDataFrame(ITEMS, "q long, question string").withColumn("w", vectors.hashed_embedding(F.col("question")))
    pairs = asked.crossJoin(store).select("q", "d", "i", "t", F.round(vectors.cosine(F.col("w"), F.col("v")), 4).alias("s")).collect()
    out = {}
    for r in sorted(pairs, key=lambda r: (r.q, -r.s, r.d, r.i)):
        out.setdefault(r.q, []).append((len(out.get(r.q, [])) + 1, r.t, str(r.d), r.s))
    return {q: best[:5] for q, best in out.items()}


def test_every_item_is_retrieved_for(spark, folder, wanted):
    got = sorted(tuple(r) for r in table_queries.qa_retrieve(spark, folder).select("query_id", "rank", "source", "score").collect())
    assert {r[0] for r in got} == {i for i, _ in ITEMS}
    assert got == sorted((q, rank, source, score) for q, best in wanted.items() for rank, _, source, score in best)


def test_every_item_has_its_prompt(spark, folder, wanted):
    want = {}
    for item, question in ITEMS:
        listed = "\n\n".join(f"[{rank}] {text} (source: {source})" for rank, text, source, _ in wanted[item])
        prompt = retrieval.TEMPLATES["qa_with_sources"].replace("{chunks}", listed).replace("{question}", question or "")
        want[item] = None if question is None else hashlib.md5(prompt.encode()).hexdigest()
    assert {r.query_id: r.prompt_md5 for r in table_queries.qa_prompt(spark, folder).collect()} == want


def test_the_index_is_read_once_and_not_shuffled(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = retrieval.index_documents(docs)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert [(r["index"], r.chunk_text) for r in index.where("doc_id = 25").orderBy("index").collect()] == [(0, "x" * 400), (1, "apples")]
    asked = spark.createDataFrame([(1, "apples")], "query_id long, question string")
    found = retrieval.retrieve(index, asked, plain=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
