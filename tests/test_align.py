"""Alignment: matches are right and in order, segments make up both texts, counts against a longest common subsequence."""

import random

from pyspark.sql import functions as F

from vellum.functions import align
from vellum.operators import comparison


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def edited(rng, lines):
    out = []
    for x in lines:
        r = rng.random()
        if r < 0.1:
            continue
        out += [x] if r < 0.8 else [f"new {rng.random()}"] if r < 0.9 else [x, f"more {rng.random()}"]
    return out


def test_matches_are_in_order_and_segments_reassemble(spark):
    rng = random.Random(1)
    cases = [([], []), ([], ["a"]), (["a"], []), (["a"], ["a"]), (["a", "a"], ["a"]), (["a", "b"], ["b", "a"]), (list("abcabba"), list("cbabac")), ([None, "a"], ["a", None])]
    for _ in range(60):
        words = [f"w{rng.randrange(rng.choice((3, 12, 60)))}" for _ in range(rng.randrange(40))]
        other = rng.choice([edited(rng, words), rng.sample(words, len(words)), words[::-1]])
        cases.append((words, other))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "n long, a array<string>, b array<string>")
    rows = align.match_each(df.withColumn("p", F.array(F.struct("a", "b"))), "p", "m").withColumn("m", F.get("m", F.lit(0)))
    rows = rows.withColumn("g", align.changes(F.col("a"), F.col("b"), F.col("m"))).withColumn("s", align.segments(F.col("a"), F.col("b"), F.col("g"), "|"))
    for r in rows.collect():
        a, b = cases[r.n]
        pairs = [(p.i, p.j) for p in r.m]
        assert all(a[i] == b[j] for i, j in pairs), r.n
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False)), r.n
        if None not in a:
            assert [x for s in r.s if s.type != "added" for x in s.text.split("|")] == a
            assert [x for s in r.s if s.type != "removed" for x in s.text.split("|")] == b


def test_longest_runs(spark):
    rng = random.Random(2)
    cases = [rng.sample(range(n), n) for n in (1, 2, 5, 30, 200)] + [list(range(500)), list(range(50, 0, -1))]
    df = spark.createDataFrame([(i, [(k, j) for k, j in enumerate(c)]) for i, c in enumerate(cases)], "n long, p array<struct<i:int,j:int>>")
    for r in df.select("n", align.longest_increasing(F.col("p")).alias("m")).collect():
        best = []
        for x in cases[r.n]:
            at = next((k for k, y in enumerate(best) if y >= x), len(best))
            best[at : at + 1] = [x]
        assert len(r.m) == len(best) and all(x.i < y.i and x.j < y.j for x, y in zip(r.m, r.m[1:], strict=False))


def test_counts_equal_a_longest_common_subsequence(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        lines = [f"line {i} {k}" if i % 2 or rng.random() < 0.9 else "" for k in range(rng.randrange(5, 80))]  # every other text has blank lines
        rows.append((i, "\n".join(lines), "\n".join(edited(rng, lines))))
    out = comparison.compare(spark.createDataFrame(rows, "id long, original string, revised string")).collect()
    for r in out:
        a, b = r.original.split("\n"), r.revised.split("\n")
        assert lcs(a, b) - a.count("") <= r.unchanged <= lcs(a, b)  # blank lines within a change may stay unmatched
        assert r.unchanged == lcs(a, b) or r.id % 2 == 0
        assert r.similarity == round(2 * r.unchanged / (len(a) + len(b)), 6)
        assert r.identical == (a == b)
        body = r.unified_diff.split("\n")[2:]
        if not r.identical:
            assert [x[1:] for x in body if x[0] != "-"] == b and [x[1:] for x in body if x[0] != "+"] == a
        for c in r.changes:
            if c.original_start:
                assert "\n".join(a[c.original_start - 1 : c.original_end]) == c.original
            if c.revised_start:
                assert "\n".join(b[c.revised_start - 1 : c.revised_end]) == c.revised
            if c.type == "modified":
                assert "".join(s.text for s in c.inline if s.type != "added") == c.original and "".join(s.text for s in c.inline if s.type != "removed") == c.revised


def test_contract(spark):
    one = "Contract title\nClient: Acme\nDuration: 12 months\nPrice: 1000 EUR\nEnd of document\n"
    two = "Contract title\nClient: Acme Corporation\nDuration: 24 months\nPayment: monthly\nEnd of document\n"
    rows = [(1, one, two), (2, "HELLO    WORLD\n", "hello world\n"), (3, None, "x"), (4, None, None), (5, "a\n" * 3000 + "b", "a\n" * 3001)]
    got = {r.id: r for r in comparison.compare(spark.createDataFrame(rows, "id long, original string, revised string"), ignore_case=True).collect()}
    (change,) = got[1].changes
    assert (change.id, change.type, change.original_start, change.original_end, change.revised_start, change.revised_end) == (2, "modified", 2, 4, 2, 4)
    assert (got[1].modified, got[1].unchanged, got[1].similarity) == (3, 3, 0.5)
    assert ("added", "Corporation") in {(s.type, s.text.strip()) for s in change.inline} or any("Corporation" in s.text for s in change.inline if s.type == "added")
    assert "+Client: Acme Corporation" in got[1].unified_diff and "-Price: 1000 EUR" in got[1].unified_diff
    assert got[2].identical and got[2].similarity == 1.0 and got[2].unified_diff == ""
    assert (got[3].modified, got[4].identical, got[5].unchanged) == (1, True, 3000)
    plan = comparison.compare(spark.createDataFrame(rows, "id long, original string, revised string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
