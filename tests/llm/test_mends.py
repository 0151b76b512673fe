"""Missing ids beside negative ones in archives; an index needs its history."""

import pytest
from pyspark.sql import functions as F

from vellum.llm import substrings, warc
from vellum.llm.common import Scratch


def test_missing_and_negative_ids(spark):
    rows = [(-1, "http://a.b/x", "same"), (None, "http://a.b/x", "same"), (-5, "http://a.b/x", "same"), (0, "http://a.b/x", "other"), (None, "http://a.b/y", "alone"), (None, "http://a.b/z", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = Scratch(spark, "test").path("ids")
    warc.write_archive(pages, folder)
    got = {(r.page_id, r.url[-1]): (r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_captures(pages, folder).collect()}
    assert got == {
        (-1, "x"): ("response", None, b"same"),
        (None, "x"): ("revisit", -1, None),
        (-5, "x"): ("revisit", -1, None),
        (0, "x"): ("response", None, b"other"),
        (None, "y"): ("response", None, b"alone"),
        (None, "z"): ("response", None, b"alone"),
    }
    one = warc.read_captures(pages.where("page_id = -1"), folder).collect()
    assert [r.page_id for r in one] == [-1]
    none = warc.read_captures(pages.where("page_id IS NULL AND url LIKE '%x'"), folder).collect()
    assert [(r.page_id, r.refers_to) for r in none] == [(None, -1)]


def test_ids_over_many_parts(spark):
    pages = spark.range(-300, 300).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("id").cast("string").alias("html"))
    folder = Scratch(spark, "test").path("parts")
    warc.write_archive(pages, folder, file_bytes=2000)
    out = warc.read_captures(pages, folder).collect()
    assert sorted(bytes(r.payload).decode() for r in out) == sorted(str(i) for i in range(-300, 300))
    assert all(r.page_id is None or r.page_id == int(r.payload) for r in out)


def test_index_needs_history(spark):
    words = " ".join(f"w{i}" for i in range(60))
    first, second = (spark.createDataFrame([(i, f"{i} {words}")], "doc_id long, text string") for i in (1, 2))
    index = substrings.FingerprintIndex(spark, Scratch(spark, "test").path("index"), fanout=2)
    assert substrings.find_repeats(first, batches=1, index=index).first().n_removed == 0
    with pytest.raises(ValueError, match="history"):
        substrings.find_repeats(second, batches=1, index=index)
    out = substrings.find_repeats(second, batches=1, index=index, history=first).first()
    assert (out.n_words, out.n_removed, out.kept_text) == (61, 60, "2")
    # The tier was full: its two runs are one now, and the catalog lists no others of this index.
    assert len(index.runs) == 1
    tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("vellum_run_")}
    assert substrings._table(index.runs[0]["name"]) in tables
    assert sum(spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Location'").first().data_type.split(":")[-1].strip("/").startswith(index.folder.split(":")[-1].strip("/")) for t in tables) == 1


def test_quality_counts_every_trusted_row(spark):
    import inspect

    from vellum.llm import quality

    # No bound on trusted rows is left, and quantiles over cells equal percentile().
    assert not hasattr(quality, "TRUSTED_ROWS") and "trusted_rows" not in inspect.signature(quality.fit).parameters
    docs = spark.range(25_000).selectExpr("id AS doc_id", "'w x' AS text")
    counts = quality._counts(docs, quality._ids(docs, "doc_id"), "doc_id", "text", 64)
    assert sum(t for t, _ in counts.values()) == sum(r for _, r in counts.values()) == 75_000
    for n in (1, 2, 7, 300):
        scores = spark.range(n).selectExpr("IF(id % 7 = 6, NULL, CAST((id * 7919) % 5003 - 2000 AS DOUBLE) / 3) AS _score")
        want = scores.selectExpr("count(_score)", "percentile(_score, 0.01)", "percentile(_score, 0.5)").first()
        got, found = quality._quantiles(scores, (0.01, 0.5))
        assert got == want[0] and all(abs(a - b) < 1e-9 for a, b in zip(found, want[1:], strict=True))
    assert quality._quantiles(spark.createDataFrame([(None,)], "_score double"), (0.5,)) == (0, [])


def test_quality_deals_out_no_texts_for_trusted_ids(spark, capsys):
    from vellum.llm import quality

    near = [-(1 << 63), -32769, -32768, -1, 0, 1, 7, 8, 32767, 32768, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, "a b") for i in [*near, *(i + 3 for i in near[:-1]), None]], "doc_id long, text string")
    trusted = quality._ids(spark.createDataFrame([(i,) for i in [*near, 5000, None]], "doc_id long"), "doc_id")
    marks = quality._marks(trusted, docs.schema["doc_id"].dataType)
    assert marks.columns == ["_range", "_bits"] and marks.count() == 6
    # None of 8, 10, ... that lie between is told to be trusted, whatever their range has else.
    told = {r.doc_id: r._trusted for r in quality._flagged(docs, marks, "doc_id").collect()}
    assert told == {i: i in near for i in told} and len(told) == len({r.doc_id for r in docs.collect()})
    # Ids that are far apart, or no numbers, are joined as they are, with the same result.
    far = spark.range(quality.MAX_RANGES + 1).select((F.col("id") * quality.RANGE).alias("_t"))
    assert quality._marks(far, docs.schema["doc_id"].dataType) is far
    assert quality._marks(trusted, spark.createDataFrame([("a",)], "doc_id string").schema["doc_id"].dataType) is trusted
    assert {r.doc_id: r._trusted for r in quality._flagged(docs, trusted, "doc_id").collect()} == told
    # With no broadcast by size, as where the ids are many, texts still stay where they are.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quality.judge(docs, trusted.withColumnRenamed("_t", "doc_id")).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_quality_keeps_its_model_out_of_the_plan(spark):
    """As a constant it was written out, for each use, in every text that Spark makes of the plan: over a megabyte, in the driver's heap."""
    from vellum.llm import quality

    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    out = quality.judge(docs, docs.where("doc_id < 30").select("doc_id"))
    assert out.count() == 40 and len(out.where("_kept")._jdf.queryExecution().toString()) < 200_000


def test_uneven_white_space_is_told_as_python_tells_it():
    import pyarrow as pa
    import pyarrow.compute as pc

    from vellum.llm.tokens import _UNEVEN

    white = [c for c in map(chr, range(0x110000)) if c.isspace()]
    others = [c for c in map(chr, [0, 0x1B, 0x84, 0x86, 0x180E, 0x200B, 0x200D, 0x2060, 0xFEFF, 0x1F600]) if not c.isspace()]
    texts = ["a", "", *white, *(t.format(c) for c in white + others for t in ("a{}b", "a{}", "{}b", "a {}b", "a{}\nb", "a{0}b{0}c"))]
    runs = [t.split() for t in texts]
    uneven = [len(t) != sum(map(len, r)) + max(0, len(r) - 1) for t, r in zip(texts, runs, strict=True)]
    assert pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNEVEN).to_pylist() == uneven


def test_blocks_of_all_lengths_come_back():
    import numpy as np

    from vellum.llm.rans import BLOCK, LANES, Table, decode_blocks, encode_blocks, scale

    rng = np.random.default_rng(5)
    blocks = [(rng.pareto(0.6, n) * 3 % 900).astype("<u2") for n in (BLOCK, 3 * LANES, 3 * LANES + 1, 1, 5 * LANES - 1, BLOCK)]
    table = Table(scale(np.bincount(np.concatenate(blocks), minlength=1000)))
    assert len(table.rest) == len(table.slots)
    for group in (blocks, [blocks[0], blocks[5]], [blocks[1], blocks[4]], [blocks[2]], [blocks[3]]):
        back = decode_blocks(encode_blocks(group, table), [len(b) for b in group], table)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(back, group, strict=True))
