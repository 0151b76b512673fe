import random

import numpy as np
import pytest
import xxhash

from vellum.llm import golay, simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    n = max(1, len(w) - 3)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(n)] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), p, str(least.get(find(i)))) for i, ((d, p)) in enumerate(prints))


def test_golay_decodes_within_three_errors():
    rng = random.Random(1)
    upper, _ = golay.tables()
    for _ in range(500):
        u = rng.randrange(1 << 12)
        word = u << 11 | int(upper[u])
        for bit in rng.sample(range(23), rng.randrange(4)):
            word ^= 1 << bit
        assert golay.decode(np.array([word]))[0] == u


def test_golay_keys_meet_within_two_errors():
    rng = random.Random(2)
    words = np.array([rng.randrange(1 << 23) for _ in range(400)], dtype=np.uint32)
    other = words.copy()
    for i in range(400):
        for bit in rng.sample(range(23), i % 3):
            other[i] ^= 1 << bit
    a, b = [{}, {}]
    for w, into in ((words, a), (other, b)):
        for r, k in zip(*golay.keys(w), strict=True):
            into.setdefault(r, set()).add(k)
    assert all(len(a[i]) in (1, 6) and a[i] & b[i] for i in range(400))
    assert all(golay.decode(words[i : i + 1])[0] in b[i] for i in range(400) if i % 3 < 2)


def test_fingerprint_equals_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "É a B", "a b c d e"] + [
        " ".join(rng.choice("the of and Ünder x y z".split()) for _ in range(rng.randrange(1, 700))) for _ in range(30)
    ]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("block", [20_000, 3])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base[:4]:
        for _ in range(25):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from vellum.llm.common import Scratch, components

    scratch = Scratch(spark, "t")
    got = {r.node: r.root for r in components(scratch, simhash.link_fingerprints(scratch, df, block)).collect()}
    label = {x: x for x in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    mask = (1 << 64) - 1
    for x in signed:
        for y in signed:
            if (x & mask ^ y & mask).bit_count() <= 4 and find(x) != find(y):
                a, b = sorted((find(x), find(y)))
                label[b] = a
    assert all(got.get(x, x) == find(x) for x in signed)


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(100, None), (7, ""), (None, " "), (None, None), (3, "one"), (3, "one"), (2, "One"), (None, "two")]
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 300))]
        rows.append((200 + i, " ".join(words)))
        words[len(words) // 2] = "changed"
        rows.append((300 - i, " ".join(words)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    mask = (1 << 64) - 1
    assert sorted((str(r.doc_id), r.fp & mask, str(r.component_id)) for r in got) == brute_classes(rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    classes = {(c if c != "None" else ("p", p)) for _, p, c in brute_classes(rows)}
    assert kept.count() == len(classes)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0
