"""Interval joins, rectangles and the span helpers they rest on."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import spans
from vellum.operators import masker, ranges


def intervals(rng, n, tall):
    """Short ones, ties, very long ones, a hot key and a hot place, negative places, empty and null ones."""
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "a", "b", None])
        start = rng.choice([rng.randrange(-3000, 3000), 100, 64, 0])
        length = rng.choice([0, 1, 2, 64, 65, rng.randrange(1, 50), rng.randrange(1, tall)])
        rows.append((i, key, start, start + length if rng.random() < 0.95 else None))
    return [*rows, (n, "a", -(10**15), 10**15), (n + 1, "hot", 5, 4)]


@pytest.mark.parametrize("bits", [0, 4, 10])
def test_overlap_join_by_hand(spark, bits):
    rng = random.Random(bits)
    one, two = intervals(rng, 150, 2000), intervals(rng, 120, 10**9)
    left = spark.createDataFrame(one, "i long, k string, start long, end long").repartition(3)
    right = spark.createDataFrame(two, "j long, k string, r_start long, r_end long").repartition(5)
    want = sorted((i, j) for i, k, s, e in one for j, m, t, u in two if k is not None and k == m and None not in (e, u) and s < e and t < u and s < u and t < e)
    got = ranges.overlap_join(left, right, ["k"], bits=bits)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert sorted(got.columns) == sorted(["k", "i", "start", "end", "j", "r_start", "r_end"])
    hit = {i for i, _ in want}
    assert {r.i for r in ranges.overlapping(left, right, ["k"], ["i"], bits=bits).collect()} == hit
    assert {r.i for r in ranges.not_overlapping(left, right, ["k"], ["i"], bits=bits).collect()} == {r[0] for r in one} - hit
    assert ranges.overlap_join(left.limit(0), right, ["k"]).count() == 0


def test_overlap_join_has_no_nested_loop_and_few_rows(spark):
    """Long intervals take part in two rows a level, not in one for each narrow bin."""
    left = spark.range(2000).select(F.lit("x").alias("k"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 5).alias("end"), "id")
    right = spark.createDataFrame([("x", 0, 10**12)], "k string, r_start long, r_end long").withColumn("j", F.lit(1))
    joined = ranges.overlap_join(left, right, ["k"], bits=2)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joined.count() == 2000
    a = ranges._placed(right, "r_start", "r_end", 2)
    assert ranges._binned(a, "r_start", "r_end", 2, [0, 1], True).count() <= 2
    guests = ranges._binned(ranges._placed(left, "start", "end", 2), "start", "end", 2, [r[0] for r in a.select("_level").collect()], False)
    assert guests.count() <= 2 * 2000


def rectangles_by_hand(text, found):
    words = []
    for n, line in enumerate(text.split("\n")):
        at = sum(len(x) + 1 for x in text.split("\n")[:n])
        words += [(at + m.start(), at + m.end(), n, m.start() * 6.0, n * 12.0, m.end() * 6.0, n * 12.0 + 10.0) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", line)]
    out = {}
    for a, b in found:
        for s, e, n, *box in words:
            if s < b and a < e:
                out.setdefault((a, n), []).append(box)
    around = lambda i, f: lambda boxes: f(x[i] for x in boxes)
    return sorted((a, n, around(0, min)(v) - 0.8, around(1, min)(v) - 0.4, around(2, max)(v) + 0.8, around(3, max)(v) + 0.4, len(v)) for (a, n), v in out.items())


def test_rectangles_by_hand(spark):
    texts = ["call +33 6 12\n34 56 78 now, a@b.org or\n\n c@d.org 10 rue de\nParis", "", None, "x@y.org", "w " * 3000 + "q@r.org", "a@b.org\n" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = masker.sensitive_spans(docs).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")
    got = ranges.span_rectangles(rows, ranges.word_boxes(docs, "doc_id"), "doc_id", ["doc_id", "start"]).collect()
    spans_of = {i: sorted((r.start, r.end) for r in rows.collect() if r.doc_id == i) for i in range(len(texts))}
    for i, text in enumerate(texts):
        mine = sorted((r.start, r.line, r.x0, r.y0, r.x1, r.y1, r.words) for r in got if r.doc_id == i)
        assert mine == rectangles_by_hand(text or "", spans_of[i]), i
    assert len({r.line for r in got if r.doc_id == 0}) > 2
    whole = spark.createDataFrame([(4, 0, 10**6)], "doc_id long, start int, end int")  # a span as long as a text
    row = ranges.span_rectangles(whole, ranges.word_boxes(docs, "doc_id"), "doc_id", ["doc_id"]).first()
    assert (row.line, row.words, row.x0, row.x1) == (0, 3001, -0.8, 6007 * 6 + 0.8)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_running_sums(spark, n):
    numbers = [(i * 7) % 5 for i in range(n)]
    df = spark.createDataFrame([(numbers,)], "a array<int>")
    assert df.select(spans.running_sums(F.col("a"))).first()[0] == [sum(numbers[:i]) for i in range(n)]


def test_matches_of_a_long_text(spark):
    text = "é1 ab22\n" * 20_000
    df = spark.createDataFrame([(text,)], "t string").repartition(1)
    got = df.select(F.explode(spans.matches(F.col("t"), r"\d+")).alias("m")).select("m.*").collect()
    assert [(r.start, r.end, r.value) for r in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", text)]
    marked = df.select(spans.replace_spans(F.col("t"), spans.matches(F.col("t"), "ab"), lambda s: F.lit("_"))).first()[0]
    assert marked == text.replace("ab", "_")


def test_words_of_a_small_file_are_not_broadcast(spark, capsys, tmp_path):
    # The file is small, so Spark takes its words for few; they are many times that.
    folder = str(tmp_path / "texts")
    spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 5000) AS text", "CAST(id AS int) AS start", "CAST(id + 3 AS int) AS end").write.parquet(folder)
    docs = spark.read.parquet(folder)
    out = ranges.span_rectangles(docs.select("doc_id", "start", "end"), ranges.word_boxes(docs, "doc_id"), "doc_id", ["doc_id"])
    out.explain()
    plan = capsys.readouterr().out
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 3
    assert out.count() == 200
