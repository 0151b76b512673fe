"""Brute force and edge cases: exact top-k, centroid clustering, filter audit."""

import hashlib
import math
import os
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF, plain
from vellum.llm import audit, centroids, topk
from vellum.llm import queries as llm
from vellum.llm.common import Scratch


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df, result = llm.QUERIES[name](spark, SF), con.sql(llm.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(result.columns) == cols
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(plain, r)) for r in result.project(", ".join(cols)).fetchall())


def vectors(rng, n=260):
    """Clusters, ties, copies, odd lengths, nulls, odd values, huge components, ids that repeat or are missing."""
    rows = []
    for i in range(n):
        base = rng.randrange(4)
        rows.append((i, [round(rng.gauss(base == j % 4, 0.3), 2) for j in range(8)]))
    rows += [(1000 + i, list(rows[0][1])) for i in range(60)] + [(50, rows[7][1]), (50, rows[7][1]), (100, list(rows[3][1]))]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2051, [math.nan] * 8), (2052, [math.inf] + [0.0] * 7), (2100, []), (2101, [0.5] * 3), (2150, [2.0] * 11)]
    return rows + [(None, rows[5][1]), (None, [0.9] * 8)]


def topk_by_hand(rows, k, scale):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = []
    for a, (qid, q) in enumerate(fine):
        if qid is None or qid % 50:
            continue
        held = lambda s: max(-(2**63), min(2**63 - 1, s))
        best = sorted((-held(sum(x * y for x, y in zip(q, v, strict=False))), i is None, i or 0) for b, (i, v) in enumerate(fine) if b != a)[:k]
        out += [(qid, r, None if none else i, -s) for r, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<double>, dist string, pivot string, uid string, v int, q int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("k,block", [(5, 4096), (1, 3), (700, 4)])
def test_top_k_by_hand(spark, monkeypatch, k, block):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rows = vectors(random.Random(3))
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k, scale=16, block=block).collect()
    assert sorted(((r.query_id, r["rank"], r.id, r.score) for r in got), key=str) == topk_by_hand(rows, k, 16)


def test_top_k_of_huge_components(spark):
    rng = random.Random(4)
    rows = vectors(rng, 40) + [(3000 + i, [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randrange(3, 25) for _ in range(8)]) for i in range(60)] + [(4000, [1e306] * 8), (4050, [1e300] * 8)]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, 4).collect()
    assert sorted(((r.query_id, r["rank"], r.id, r.score) for r in got), key=str) == topk_by_hand(rows, 4, 256)


def test_top_k_of_nothing(spark):
    df = frame(spark, vectors(random.Random(1), 10), 1)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert topk.top_k(df, F.lit(False), 5).collect() == []
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone, F.col("vec_id") % 50 == 0, 5).collect() == []


def test_annuli_are_ruled_out(spark):
    """Tight clusters: the second round scores a small part of all pairs."""
    rng = np.random.default_rng(5)
    heart = rng.normal(0, 4, (40, 8))
    rows = [(i, (heart[i % 40] + rng.normal(0, 0.02, 8)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(((r.query_id, r["rank"], r.id, r.score) for r in got), key=str) == topk_by_hand(rows, 5, 256)
    assert 0 < got[0].met < 0.35 * 80 * 4000


def clusters_by_hand(rows, count, rounds, width, scale):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in fine if i is not None)
    centres = [v for _, v in first[:count]]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in fine]
        if n < rounds:
            for j in {j for _, j in near}:
                mine = [v for (_, v), (_, m) in zip(fine, near, strict=True) if m == j]
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, j, min(d, 2**63 - 1)) for (i, _), (d, j) in zip(fine, near, strict=True)), key=str), centres


@pytest.mark.parametrize("huge", [False, True])
def test_clusters_by_hand(spark, huge):
    rng = random.Random(6)
    rows = vectors(rng)
    if huge:
        rows += [(5000 + i, [rng.gauss(0, 1) * 10.0 ** rng.randrange(2, 20) for _ in range(8)]) for i in range(40)] + [(6000, [2.0**23 + 0.5] * 8), (6001, [2.0**23] * 8)]
    for count, scale in ((5, 4), (16, 64), (1000, 1)):
        found, last = centroids.cluster(frame(spark, rows), count, 3, 8, scale)
        want, centres = clusters_by_hand(rows, count, 3, 8, scale)
        assert last == centres
        assert sorted(((r.id, r.number, r.distance) for r in found.collect()), key=str) == want


def test_screen_never_loses_the_nearest():
    rng = np.random.default_rng(7)
    for size in (1, 300, 2**20, 2**23, 2**30):
        x, c = rng.integers(-size, size + 1, (400, 64)), rng.integers(-size, size + 1, (16, 64))
        x[:100] = c[0] + rng.integers(-1, 2, (100, 64))  # near ties around one centroid
        c[1] = c[0] + rng.integers(-1, 2, 64)
        exact = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(axis=2)
        may = centroids.screen(x, c)
        assert all(may[i][exact[i] == exact[i].min()].all() for i in range(len(x)))
        number, far, _ = centroids.nearest(x.astype(object), c.astype(object))
        assert number.tolist() == [int(np.argmin(e)) for e in exact] and far.tolist() == exact.min(axis=1).tolist()
        assert may.mean() < 0.5 or size == 1


def test_clusters_of_nothing(spark):
    df = frame(spark, vectors(random.Random(1), 10), 1)
    for rows in (df.limit(0), df.where("vec_id IS NULL"), df.where("size(embedding) <> 8")):
        found, last = centroids.cluster(rows, 4, 3, 8, 4)
        assert found.collect() == [] == last and centroids.report(found, last, Scratch(spark, "c")).collect() == []
    found, last = centroids.cluster(df.where("vec_id = 3"), 4, 3, 8, 4)
    row = centroids.report(found, last, Scratch(spark, "c")).first()
    assert (row.number, row.distance, row.cluster_inertia, row.inertia) == (0, 0, 0, 0)
    assert row.centroid_sha256 == hashlib.sha256(",".join(map(str, last[0])).encode()).hexdigest()


def audit_by_hand(docs, labels):
    good = {i for i, g, _ in labels if g == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in docs),
        }
        rows.append((part or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(here)
                failing = sum(f in r[1] for r in mine)
                out[part, order, step] = [len(left), len(here), failing - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audit_tables(rng):
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(120):
        text = " ".join(rng.sample(words, rng.choice((20, 49, 50, 90))))
        text = text.upper() if rng.random() < 0.3 else text
        text = " ".join([text] * 2) if rng.random() < 0.3 else text
        docs.append((i, text + rng.choice(["", "", " a|b", " 5%", " 　x", "\n\t\x0b "]), rng.choice(["a", "b", "", None])))
    docs += [(200 + i, docs[3][1], rng.choice(["a", "b"])) for i in range(50)] + [(-5, docs[9][1], "c"), (9, docs[9][1], "a"), (9, docs[9][1], "a"), (10, docs[9][1], "a")]
    docs += [(None, docs[3][1], "a"), (None, "x", "a"), (None, "x", "d"), (300, None, "a"), (301, "", "b"), (302, None, None), (303, "word " * 30_000, "a"), (304, "É" * 60, "a")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 250, 2)] + [(9, 1, 0), (9, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_by_hand(spark):
    docs, labels = audit_tables(random.Random(8))
    told = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, mask string")
    df = spark.createDataFrame([(*r, "m", True) for r in docs], "doc_id long, text string, source string, mask string, good boolean").repartition(7)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(df, told).collect()}
    assert got == audit_by_hand(docs, labels)
    assert audit.audit(df.limit(0), told).collect() == []
    assert len(audit.audit(df, told.limit(0)).collect()) == len(got)


def test_parity_sums_invert(spark):
    rng = random.Random(9)
    rows = [(rng.choice("pq"), rng.random() < 0.5, rng.randrange(8), rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, fine boolean, mask int, n long")
    for r in audit.cells(df, ["fine"], 3).collect():
        assert r["all"] == [sum(n for p, _, m, n in rows if (p, m) == (r.part, i)) for i in range(8)]
        assert r.fine == [sum(n for p, f, m, n in rows if f and (p, m) == (r.part, i)) for i in range(8)]
    with pytest.raises(ValueError):
        audit.cells(df, [], 7)
