"""Block products against plain pairs, odd vectors and copies among them."""

import math

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import vectors
from vellum.operators import products, retrieval

KIND = "vec_id long, embedding array<float>, label int"


def table(spark, n=300, odd=True):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[40:90] = x[3]  # copies, more than k
    rows = [(i, [float(c) for c in v], int(i % 3)) for i, v in enumerate(x)]
    if odd:
        rows += [(n, None, 0), (n + 1, [1.0, 2.0], 1), (n + 2, [0.0] * 8, 2), (n + 3, [None] + [1.0] * 7, 0), (n + 4, [math.nan] + [1.0] * 7, 1), (n + 5, [1.0] * 8, None), (n + 10, None, None)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def test_top_k_equals_all_pairs(spark):
    for odd in (False, True):
        store = table(spark, odd=odd)
        asked = store.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        pairs = store.crossJoin(asked).select("query_id", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("query")), 4).alias("score"))
        want = {}
        for r in sorted(pairs.where("score IS NOT NULL").collect(), key=lambda r: (r.query_id, not math.isnan(r.score), -r.score if not math.isnan(r.score) else 0, r.vec_id)):
            want.setdefault(r.query_id, []).append((r.vec_id, str(r.score)))
        got = {}
        for r in sorted(retrieval.top_k(store, asked, 5).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.vec_id, str(r.score)))
        assert got == {q: v[:5] for q, v in want.items()}


def test_claims_equal_all_pairs_and_no_pair_is_shuffled(spark):
    for odd in (False, True):
        rows = table(spark, odd=odd)
        claims = rows.where("vec_id % 5 = 0").select("label", F.col("vec_id").alias("c"), F.col("embedding").alias("claim_vector"))
        evidence = rows.where("vec_id % 5 <> 0").select("label", F.col("vec_id").alias("e"), F.col("embedding").alias("evidence_vector"))
        sim = F.coalesce(vectors.dot(F.col("claim_vector"), F.col("evidence_vector")), F.lit(0.0))
        best = claims.join(evidence, "label", "left").groupBy("label", "c").agg(F.max(F.struct(sim.alias("s"), (-F.col("e")).alias("e"))).alias("b"))
        want = best.select("label", "c", F.round("b.s", 4), -F.col("b.e")).collect()
        out = retrieval.review_claims(claims, evidence, "label", "c", "e")
        got = out.select("label", "c", "max_similarity", "best_evidence").collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in want)))
        if not odd:
            assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_hashed_embedding_equals_word_by_word(spark):
    rows = spark.createDataFrame([(x,) for x in ("Red apples, red pears", "", None, " - ", "été à l'eau 3 3 3")], "t string").repartition(2)
    words = F.filter(F.split(F.lower("t"), r"(?U)\W+", -1), lambda w: w != "")
    place = lambda i: F.aggregate(
        words, F.lit(0.0), lambda acc, w: acc + F.when(F.pmod(F.xxhash64(w), F.lit(64)) == i, F.when(F.xxhash64(w) >= 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    )
    raw = F.when(F.col("t").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(63)), place))
    want = rows.select("t", raw.alias("r")).withColumn("n", vectors.norm(F.col("r"))).select("t", F.transform("r", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0)))
    out = rows.select("t", vectors.hashed_embedding(F.col("t")))
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(tuple(r)) for r in want.collect())
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_with_struct_keys_keeps_few_of_many_ties(spark):
    rows = [(d, i, f"t{i}", [1.0, 0.0] if d % 2 else [0.6, 0.8]) for d in range(400) for i in range(3)] + [(None, 7, None, [1.0, 0.0])]
    store = spark.createDataFrame(rows, "d long, i int, t string, v array<double>").repartition(3).select(F.struct("d", "i", "t").alias("key"), "v")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], "q long, w array<double>")
    assert products.nearest(store, asked, 2, 4, "key", "v", "q", "w", True, 1e-4).count() < 150
    got = {}
    for r in retrieval.top_k(store, asked, 4, "v", "key", "q", "w", plain=True).orderBy("rank").collect():
        got.setdefault(r.q, []).append((r.key.d, r.key.i, r.score))
    assert got[1] == [(None, 7, 1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
    assert got[2] == [(None, 7, 0.0), (0, 0, 0.0), (0, 1, 0.0), (0, 2, 0.0)]
    assert got[3] == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (2, 0, 1.0)]
