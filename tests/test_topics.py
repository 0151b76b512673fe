"""Topic features against a plain version, silhouettes, and clusters that don't depend on partitions."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import topics

SIX = [
    "budget finance accounting invoice revenue profit tax budget finance accounting",
    "invoice payment supplier accounting amount tax finance invoice payment",
    "financial revenue profit budget accounting company finance revenue",
    "doctor patient hospital clinic medicine health treatment doctor patient",
    "medicine pharmacy treatment patient health hospital medicine doctor",
    "healthcare clinic nurse doctor patient hospital treatment health",
]


def terms_by_hand(text):
    folded = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    w = re.findall(r"\b[^\W\d_][\w'-]{1,}\b", folded)
    chars = []
    for word in text.lower().split():
        p = f" {word} "
        for n in (3, 4, 5):
            chars.append(p[:n])
            at = 0
            while at + n < len(p):
                at += 1
                chars.append(p[at : at + n])
            if at == 0:
                break
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]), Counter(chars)


def features_by_hand(texts, max_words, max_chars, weight=0.35):
    counted = [terms_by_hand(t) for t in texts]
    vectors = [{} for _ in texts]
    for kind, (cap, scale, first) in enumerate(((max_words, 1.0, 0), (max_chars, weight, max_words))):
        total, df = Counter(), Counter()
        for c in counted:
            total.update(c[kind])
            df.update(c[kind].keys())
        known = {t: first + i for i, (t, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:cap])}
        for v, c in zip(vectors, counted, strict=True):
            own = {known[t]: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c[kind].items() if t in known}
            size = math.sqrt(sum(x * x for x in own.values()))
            v.update({i: scale * x / size for i, x in own.items()})
    return [{i: x / math.sqrt(sum(y * y for y in v.values())) for i, x in v.items()} for v in vectors]


def corpus(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def test_features_by_hand(spark):
    texts = [*SIX, "L'été à Zürich: it's 1abc-def x ab - a- -b don't", "Ab ab aB\n\tcafé café über über_all 3rd", "été naïve"]
    for caps in ((16_000, 10_000), (12, 30)):
        got = {r.doc_id: dict(zip(r["at"], r.weight, strict=True)) for r in topics.features(corpus(spark, texts), "doc_id", "text", *caps).collect()}
        for i, want in enumerate(features_by_hand(texts, *caps)):
            mine = got.get(i, {})
            assert set(mine) == set(want), (i, caps)
            assert all(abs(mine[t] - want[t]) < 1e-12 for t in want)


def test_six_texts(spark):
    for k in (2, None):
        rows = topics.topics(corpus(spark, SIX), "doc_id", k=k).collect()
        cluster = {r.doc_id: r.cluster for r in rows}
        assert len({cluster[i] for i in (0, 1, 2)}) == len({cluster[i] for i in (3, 4, 5)}) == 1 and cluster[0] != cluster[3]
        assert all(0.5 < r.similarity <= 1 for r in rows)
    alike = topics.topics(corpus(spark, SIX[:1] * 2), "doc_id").collect()
    apart = topics.topics(corpus(spark, [SIX[0], SIX[5]]), "doc_id").collect()
    assert len({r.cluster for r in alike}) == 1 and len({r.cluster for r in apart}) == 2
    odd = topics.topics(corpus(spark, [*SIX, "", None, " \n"]), "doc_id", k=2).collect()
    assert len(odd) == 9 and {(r.cluster, r.similarity) for r in odd if r.doc_id > 5} == {(0, 0.0)}
    assert topics.topics(corpus(spark, SIX).limit(0), "doc_id").collect() == []


def test_silhouette_by_hand(spark):
    docs = corpus(spark, SIX)
    rows = topics.features(docs, "doc_id", "text", 300, 600)
    dense = np.zeros((6, 900))
    for r in rows.collect():
        dense[r.doc_id, r["at"]] = r.weight
    labels = [0, 0, 1, 1, 1, 2]
    centres = np.stack([dense[[i for i, x in enumerate(labels) if x == c]].mean(axis=0) for c in range(3)])
    near = ((dense[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    far = 1 - dense @ dense.T
    scores = []
    for i in range(6):
        same = [j for j in range(6) if near[j] == near[i] and j != i]
        a = far[i, same].mean() if same else 0
        b = min(far[i, near == c].mean() for c in set(near) - {near[i]})
        scores.append((b - a) / max(a, b) if same else 0)
    assert abs(topics.silhouettes(rows, [centres])[0] - np.mean(scores)) < 1e-9


def test_mini_batches_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(topics, "SAMPLE", 40)
    monkeypatch.setattr(topics, "LEAST_BATCH", 30)
    rng = random.Random(2)
    themes = [[f"{a}{i}" for i in range(30)] for a in ("alpha", "beta", "gamma")]
    texts = [" ".join(rng.choices(themes[i % 3], k=25)) for i in range(240)]
    out = []
    for parts in (1, 7):
        rows = topics.topics(corpus(spark, texts, parts), "doc_id", max_k=5, max_words=500, max_chars=500).collect()
        out.append(sorted((r.doc_id, r.cluster, r.similarity) for r in rows))
    assert out[0] == out[1]
    assert {len({c for i, c, _ in out[0] if i % 3 == t}) for t in range(3)} == {1} and len({c for _, c, _ in out[0]}) == 3


def test_batches_cover_all_rows_once_an_epoch(spark, monkeypatch):
    monkeypatch.setattr(topics, "SAMPLE", 10)
    monkeypatch.setattr(topics, "LEAST_BATCH", 20)
    rows = topics.features(corpus(spark, [f"{t} number{i}" for i, t in enumerate(SIX * 20)]), "doc_id", "text", 300, 600)
    met, real = [], topics._sums
    monkeypatch.setattr(topics, "_sums", lambda *a: met.append(real(*a)) or met[-1])
    topics.fit(rows, "doc_id", [2], 900, 42)
    assert [sum(m[1].sum() for m in met[e * 6 : e * 6 + 6]) for e in range(2)] == [120, 120]


def test_vocabulary_shuffles_terms_not_documents(spark):
    docs = spark.createDataFrame([(0, "a bb cc bb"), (1, "bb cc")], "doc_id long, text string")
    plan = topics.vocabulary(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(kind" not in plan


def test_terms_are_counted_where_documents_lie(spark, capsys):
    texts = [(1, "Été bleu bleu"), (2, "ete BLEU x-ray"), (1, "bleu  ete"), (3, None), (4, "?!"), (5, "bleu " * 300 + "ete")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    known = topics.vocabulary(docs, "doc_id", max_words=8, max_chars=12)
    rows = topics.term_counts(docs, known, "doc_id", "text", 20)
    rows.explain()
    assert capsys.readouterr().out.count("Exchange") == 1  # that of repartition()
    terms = {r["at"]: (r.kind, r.term) for r in known.collect()}

    def want(text):
        out = {}
        text = text or ""
        words = [w for w in re.findall(r"[^\W\d_][\w'-]+\b", text.lower().replace("é", "e"))]
        parts = [f" {w} "[i : i + n] for w in text.lower().split() for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        for t in [*(("w", x) for x in [*words, *map(" ".join, zip(words, words[1:], strict=False))]), *(("c", x) for x in parts)]:
            if t in terms.values():
                out[t] = out.get(t, 0) + 1
        return out

    got = sorted((r.doc_id, sorted((terms[a], n) for a, n in zip(r["at"], r.tf, strict=True))) for r in rows.collect())
    assert got == sorted((i, sorted(want(t).items())) for i, t in texts)
    assert all(list(r["at"]) == sorted(r["at"]) for r in rows.collect())
    # Rows of one key are one document.
    found = {r.doc_id: r for r in topics.features(docs, "doc_id", max_words=8, max_chars=12).collect()}
    assert sorted(found) == [1, 2, 5]
    both = spark.createDataFrame([(1, "Été bleu bleu"), (2, "bleu  ete")], "doc_id long, text string")
    parts = topics.term_counts(both, known, "doc_id", "text", 20).collect()
    assert set(found[1]["at"]) == {a for r in parts for a in r["at"]}
