"""The near_dedup stage of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest

from vellum.llm import jaccard


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(d for (d, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}


@pytest.mark.parametrize("sample", [10_000, 20])
def test_classes_equal_brute_force(spark, sample, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(40)]
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e"]
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randrange(8, 200))]
        if i % 4 == 0:
            words[3:3] = common
        texts.append(" ".join(words))
        for _ in range(i % 5):  # edits around the bound
            for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words[rng.randrange(3) :]))
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(60):  # a group of near copies of one text, whose members differ among each other
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = rng.choice(vocab)
        texts.append(" ".join(words))
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    expected = kept_by_hand(rows)
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, rows[9]]], "doc_id long, text string, fp string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(expected)
    assert len(expected) < len(rows) - 60


def test_rows_without_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "A b"), (None, "c"), (4, "c")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in jaccard.drop_near_duplicates(docs).collect()) == ["4", "None"]
    assert jaccard.drop_near_duplicates(docs.limit(0)).count() == 0


def test_sketches_lose_no_link(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 700, 5000):
        whole = np.unique(rng.integers(-(2**63), 2**63 - 1, n + n // 3))
        for cut in (0, 1, n // 10, n // 5, n // 3):
            x, y = whole[: len(whole) - cut], whole[cut:]
            apart = len(np.setxor1d(x, y))
            assert jaccard._apart(jaccard._sketch(x), jaccard._sketch(y)) <= apart
    far = [np.unique(rng.integers(-(2**63), 2**63 - 1, 400)) for _ in range(2)]
    assert 9 * jaccard._apart(*map(jaccard._sketch, far)) > sum(map(len, far))


def test_sets_are_made_for_near_pairs_only(spark, monkeypatch):
    # Forty texts share a passage that puts them into the same buckets; two of them are near-duplicates.
    rng = random.Random(4)
    footer = " ".join(f"f{i}" for i in range(60))
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(80)) + " " + footer for _ in range(40)]
    texts.append(texts[7] + " more")
    made, real = [], jaccard._Verifier.done

    def done(self):
        made.append(self._made().select("s").distinct().count())
        real(self)

    monkeypatch.setattr(jaccard._Verifier, "done", done)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = jaccard.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert made == [2]
