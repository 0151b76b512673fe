"""The pipeline against a brute-force version of its stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import base_by_hand, hits_by_hand, lines_by_hand, prose  # noqa: E402


def tables(spark, folder):
    import random

    rng = random.Random(11)
    item = prose(rng, 14)
    shared = f"{prose(rng, 12)}\n{prose(rng, 12)}"
    docs = []
    for i in range(40):
        text = f"{prose(rng, 70)}\n{prose(rng, 20)}"
        if i % 5 == 0:
            text += "\n" + shared
        if i % 7 == 0:
            text += " " + item
        docs.append((i, text, "en", "s", len(text)))
    docs += [(100 + i, docs[i][1], "en", "s", 0) for i in range(8)]
    docs += [(200, None, "en", "s", 0), (201, "", None, "s", 0), (202, "too short", "en", "s", 9), (203, "a b c " * 40, "en", "s", 240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, item


def test_pipeline(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    docs, item = tables(spark, folder)
    at = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = f"{tmp_path}/{name}"
        at.write.parquet(f"file://{path}")
        at = spark.read.parquet(f"file://{path}")
        kept[name] = {r.doc_id: (r.text, r.n_chars) for r in at.collect()}
    first = {i: t for i, t, *_ in docs if not base_by_hand(t)[5]}
    assert {i: t for i, (t, _) in kept["quality_rules"].items()} == first
    from pyspark.sql import functions as F

    keyed = spark.createDataFrame(list(first.items()), "i long, t string").select("i", "t", F.lit(0), F.xxhash64("i", "t")).collect()
    cut = {d: t for d, t, _, _ in lines_by_hand([tuple(r) for r in keyed], 2)}
    assert {i: t for i, (t, _) in kept["line_dedup"].items()} == cut
    assert all(n == len(t) for t, n in kept["line_dedup"].values())
    near = kept["near_dedup"]
    assert set(near) <= set(cut) and len(near) < len(cut) and all(near[i][0] == cut[i] for i in near)
    assert not any(100 <= i < 108 for i in near if cut[i])
    clean = {d for d, _, h, _ in hits_by_hand([(i, t, 0) for i, (t, _) in near.items()], [(1, item)], 10) if not h}
    assert set(kept["benchmark_decontamination"]) == clean and len(clean) < len(near)
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == clean
