"""Topics: TF-IDF features of words and characters, and mini-batch K-Means whose results don't depend on partitions.

Features: words (a letter, then letters, digits, ' or -, ending in a letter or digit; accents folded) and pairs of
neighbouring words; runs of three to five characters inside words padded with a blank on both sides. Of each kind the terms with
the highest counts make up the vocabulary, equal counts by term. A term weighs (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1); each kind
is L2-normalised, characters count ``char_weight`` times, and the whole is normalised again. The vocabulary goes out to
the tasks, which count its terms document by document, so no terms of documents are shuffled; each distinct word of a while is taken apart once.

Clustering: centroids start from K-Means (k-means++, ten seeds) on at most ``SAMPLE`` documents, the first by hash. Then all documents
take part: hashed into batches, each batch moves its centroids by the mean of what they have met so far, for some epochs. Sums
are in whole numbers of 2^-40, so neither the order of rows nor their partitions matter. All numbers of topics that are tried go
through the same passes. Without a number of topics, the one with the best cosine silhouette is taken; that of all documents, which
for vectors of length 1 follows from the clusters' sums.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.session import written

WORD = r"(?U)\b[^\W\d_][\w'-]+\b"
#: Documents on which centroids start; seeds of that; batches and epochs after it; documents a batch has at least, about.
SAMPLE, RESTARTS, BATCHES, EPOCHS, LEAST_BATCH = 1024, 10, 8, 2, 256
#: Similarity from which two documents alone are one topic.
SAME_TOPIC = 0.42
_ONE = 2**40


def _accents() -> tuple[str, str]:
    """Letters with marks and what is left of them, by Unicode's own decomposition; marks that stand alone have no partner and go."""
    pairs = []
    for code in range(0x80, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    marks = [chr(c) for c in range(0x300, min(0x370, sys.maxunicode))]
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    return F.translate(text, *_accents())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(fold_accents(F.lower(text)), F.lit(WORD), F.lit(0))


def word_terms(text: Column) -> Column:
    """Words and pairs of neighbouring words, repeats included."""
    words = _words(text)
    pairs = lambda w: F.concat(w, F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def char_terms(word: Column) -> Column:
    """Runs of 3, 4 and 5 characters of a word between blanks, repeats included."""
    w = F.concat(F.lit(" "), word, F.lit(" "))
    runs = lambda n: F.when(F.char_length(w) >= n, F.transform(F.sequence(F.lit(1), F.char_length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[runs(n) for n in (3, 4, 5)])


def _char_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")


def vocabulary(docs: DataFrame, key: str, text_col: str = "text", max_words: int = 16_000, max_chars: int = 10_000) -> DataFrame:
    """(kind, term, n, at): the terms of each kind with the highest counts, numbered from 0; characters come after words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.explode(word_terms(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # Characters come from the distinct words of the whole table, so each word is taken apart once.
    parts = docs.select(F.explode(_char_words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    chars = parts.select(F.explode(char_terms(F.col("word"))).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))

    def best(counts: DataFrame, kind: str, most: int, first: int) -> DataFrame:
        """The ``most`` highest counts: the best of each task meet, and only they are numbered in one."""
        top = counts.orderBy(F.desc("n"), "term").limit(most)
        rank = F.row_number().over(W.orderBy(F.desc("n"), "term"))
        return top.select(F.lit(kind).alias("kind"), "term", "n", (rank + (first - 1)).alias("at"))

    return best(words, "w", max_words, 0).unionByName(best(chars, "c", max_chars, max_words))


def _count_terms(known: pa.Table, key: str, width: int, most: int = 100_000, remembered: int = 200_000):
    """Rows (key, _w: words, _c: words for characters) -> (key, at, tf): the terms of ``known`` in each, in order of ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words = known.filter(pc.equal(known["kind"], "w"))
        terms, places = of_words["term"].combine_chunks(), of_words["at"].to_numpy()
        chars = {t: i for k, t, i in zip(*(known[c].to_pylist() for c in ("kind", "term", "at")), strict=True) if k == "c"}
        seen: dict[str, np.ndarray] = {}

        def char_places(word: str) -> np.ndarray:
            if word not in seen:
                w = f" {word} "
                found = [chars.get(w[i : i + n]) for n in (3, 4, 5) for i in range(len(w) - n + 1)]
                seen[word] = np.array([i for i in found if i is not None], dtype=np.int64)
            return seen[word]

        def codes(lists: pa.Array, own: pa.Array) -> np.ndarray:
            """row * width + at of each term that is known, repeats included."""
            words, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            out = []
            for values, at in ((words, row), (pc.binary_join_element_wise(words[:-1], words[1:], " "), np.where(row[:-1] == row[1:], row[:-1], -1))) if len(words) else ():
                i = pc.fill_null(pc.index_in(values, value_set=terms), -1).to_numpy()
                there = (i >= 0) & (at >= 0)
                out.append(at[there] * width + places[i[there]])
            told, row = own.flatten().dictionary_encode(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            if len(told):
                each = [char_places(w) for w in told.dictionary.to_pylist()]
                length = np.array([len(x) for x in each])
                flat, begin, which = np.concatenate(each), np.cumsum(length) - length, told.indices.to_numpy()
                n = length[which]
                at = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append(np.repeat(row, n) * width + flat[at])
            return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

        for batch in batches:
            words, own = batch.column("_w"), batch.column("_c")
            ends = np.cumsum(own.value_lengths().to_numpy() + words.value_lengths().to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
                if len(seen) > remembered:
                    seen.clear()
                code, tf = np.unique(codes(words.slice(lo, hi - lo), own.slice(lo, hi - lo)), return_counts=True)
                begins = pa.array(np.searchsorted(code // width, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(begins, pa.array(x)) for x in ((code % width).astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), *lists], names=[key, "at", "tf"])
                lo = hi

    return run


def term_counts(docs: DataFrame, known: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """(key, at array<int>, tf array<long>) of each row of ``docs``; ``known``: at most ``width`` terms, as from vocabulary(). Narrow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = docs.select(key, _words(text).alias("_w"), _char_words(text).alias("_c"))
    kind = docs.schema[key].dataType.simpleString()
    return listed.mapInArrow(_count_terms(known.select("kind", "term", "at").toArrow(), key, width), f"`{key}` {kind}, at array<int>, tf array<long>")


def features(docs: DataFrame, key: str, text_col: str = "text", max_words: int = 16_000, max_chars: int = 10_000, char_weight: float = 0.35) -> DataFrame:
    """(key, at array<int>, weight array<double>) for each document that has a term of the vocabulary, in order of ``at``."""
    known, width = written(vocabulary(docs, key, text_col, max_words, max_chars), "vocabulary"), max_words + max_chars
    rows = written(term_counts(docs, known, key, text_col, width).where(F.size("at") > 0), "counts")
    if rows.groupBy(key).count().where("count > 1").limit(1).count():  # rows of one key are one document
        each = rows.select(key, F.explode(F.arrays_zip("at", "tf")).alias("t")).groupBy(key, "t.at").agg(F.sum("t.tf").alias("tf"))
        whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "tf"))).alias("t"))
        rows = written(whole.select(key, F.col("t.at").alias("at"), F.col("t.tf").alias("tf")), "counts")
    n = docs.count()
    found = rows.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df"))
    rare = {r["at"]: r.x for r in found.select("at", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("x")).collect()}  # width rows at most
    kind = docs.schema[key].dataType.simpleString()
    weigh = _weigh(np.array([rare.get(i, 0.0) for i in range(width)]), key, max_words, char_weight)
    return rows.mapInArrow(weigh, f"`{key}` {kind}, at array<int>, weight array<double>")


def _weigh(rare: np.ndarray, key: str, max_words: int, char_weight: float):
    """Rows (key, at, tf) -> (key, at, weight); ``rare``: the inverse document frequency of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, places, tf, begins in _pieces(batch, "tf"):
                x, is_word = (1 + np.log(tf)) * rare[places], places < max_words
                words, chars = (np.sqrt(np.add.reduceat(np.where(k, x * x, 0.0), begins)) for k in (is_word, ~is_word))
                whole = np.sqrt((words > 0) + char_weight * char_weight * (chars > 0))
                ends = np.append(begins, len(places))
                row = np.repeat(np.arange(hi - lo), np.diff(ends))
                weight = x * np.where(is_word, 1 / np.where(words > 0, words, 1)[row], char_weight / np.where(chars > 0, chars, 1)[row]) / whole[row]
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in (places, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), *lists], names=[key, "at", "weight"])

    return run


def _pieces(batch: pa.RecordBatch, of: str = "weight", most: int = 100_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last, places, weights, begins) of rows that together have about ``most`` terms."""
    at, weight = batch.column("at"), batch.column(of)
    ends = np.cumsum(np.asarray(at.value_lengths()))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most)))
        yield lo, hi, np.asarray(at.slice(lo, hi - lo).flatten()), np.asarray(weight.slice(lo, hi - lo).flatten()), np.concatenate([[0], ends[lo : hi - 1] - before]).astype(int)
        lo = hi


def _products(places: np.ndarray, weights: np.ndarray, begins: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows times centroids; no row is without terms."""
    return np.add.reduceat(centroids.T[places] * weights[:, None], begins, axis=0)


def _choose(products: np.ndarray, centroids: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each row and number of topics the slot of the nearest centroid."""
    far = (centroids * centroids).sum(axis=1) - 2 * products
    ends = np.cumsum(sizes)
    return np.stack([e - k + far[:, e - k : e].argmin(axis=1) for k, e in zip(sizes, ends, strict=True)], axis=1)


def _step(centroids: np.ndarray, sizes: list[int]):
    """Rows -> (slot, at, total) of a task: sums of weights by slot in whole numbers of 2^-40, and at -1 how many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=np.int64)
        for batch in batches:
            for lo, hi, places, weights, begins in _pieces(batch):
                slots = _choose(_products(places, weights, begins, centroids), centroids, sizes)
                owner = np.repeat(np.arange(hi - lo), np.diff([*begins, len(places)]))
                whole = np.rint(weights * _ONE).astype(np.int64)
                for s in slots.T:
                    np.add.at(total, (s[owner], places + 1), whole)
                    np.add.at(total, (s, 0), 1)
        slot, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(total[slot, at])], names=["slot", "at", "total"])

    return run


def _sums(rows: DataFrame, centroids: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weights, numbers of rows) by slot."""
    parts = rows.select("at", "weight").mapInArrow(_step(centroids, sizes), "slot int, at int, total long")
    found = parts.groupBy("slot", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("total")).toArrow()
    out = np.zeros((len(centroids), centroids.shape[1] + 1))
    out[found["slot"].to_numpy(), found["at"].to_numpy() + 1] = found["total"].to_numpy()
    return out[:, 1:] / _ONE, out[:, 0]


def _gram(places: list[np.ndarray], weights: list[np.ndarray], width: int, block: int = 2000) -> np.ndarray:
    out = np.zeros((len(places), len(places)))
    for lo in range(0, width, block):
        dense = np.zeros((len(places), block))
        for i, (p, w) in enumerate(zip(places, weights, strict=True)):
            a, b = np.searchsorted(p, (lo, lo + block))
            dense[i, p[a:b] - lo] = w[a:b]
        out += dense @ dense.T
    return out


def start(gram: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels of K-Means on the documents of a Gram matrix: the best of some seeds, each begun by k-means++."""
    n, own = len(gram), np.diag(gram)
    best = (np.inf, np.zeros(n, dtype=int))
    for r in range(RESTARTS):
        rng = np.random.default_rng([seed, k, r])
        picked = [int(rng.integers(n))]
        far = np.maximum(own + own[picked[0]] - 2 * gram[picked[0]], 0)
        while len(picked) < k:
            share = far / far.sum() if far.sum() > 0 else np.full(n, 1 / n)
            picked.append(int(rng.choice(n, p=share)))
            far = np.minimum(far, np.maximum(own + own[picked[-1]] - 2 * gram[picked[-1]], 0))
        labels = (own[picked] - 2 * gram[:, picked]).argmin(axis=1)
        for _ in range(50):
            member = np.eye(k)[labels]
            size = np.maximum(member.sum(axis=0), 1)
            reach = gram @ member / size
            distance = (member * reach).sum(axis=0) / size - 2 * reach
            distance[:, member.sum(axis=0) == 0] = np.inf
            after = distance.argmin(axis=1)
            if (after == labels).all():
                break
            labels = after
        inertia = float((own + distance[np.arange(n), labels]).sum())
        if inertia < best[0] - 1e-12:
            best = (inertia, labels)
    return best[1]


def fit(rows: DataFrame, key: str, ks: list[int], width: int, seed: int) -> list[np.ndarray]:
    """Centroids for each number of topics in ``ks``, from rows of features()."""
    first = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(SAMPLE).select("at", "weight").toArrow()
    places, weights = [[np.array(x) for x in first[c].to_pylist()] for c in ("at", "weight")]
    gram = _gram(places, weights, width)
    centroids, counts = np.zeros((sum(ks), width)), np.zeros(sum(ks))
    for k, end in zip(ks, np.cumsum(ks), strict=True):
        for i, label in enumerate(start(gram, k, seed)):
            centroids[end - k + label, places[i]] += weights[i]
            counts[end - k + label] += 1
    centroids /= np.maximum(counts, 1)[:, None]
    n = rows.count()
    batches = max(1, min(BATCHES, n // LEAST_BATCH))
    for epoch in range(EPOCHS):
        for b in range(batches):
            at = F.pmod(F.xxhash64(F.lit(seed + epoch), F.col(key).cast("string"), F.lit("batch")), F.lit(batches)) == b
            sums, met = _sums(rows.where(at), centroids, ks)
            centroids = np.where((counts + met > 0)[:, None], (centroids * counts[:, None] + sums) / np.maximum(counts + met, 1)[:, None], centroids)
            counts = counts + met
    return [centroids[e - k : e] for k, e in zip(ks, np.cumsum(ks), strict=True)]


def silhouettes(rows: DataFrame, found: list[np.ndarray]) -> list[float]:
    """The mean cosine silhouette of all rows for each set of centroids; 0 where all rows are in one cluster."""
    centroids, sizes = np.concatenate(found), [len(c) for c in found]
    sums, met = _sums(rows, centroids, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sizes), dtype=np.int64)
        for batch in batches:
            for _, _, places, weights, begins in _pieces(batch):
                slots = _choose(_products(places, weights, begins, centroids), centroids, sizes)
                reach = _products(places, weights, begins, sums)  # similarities to all rows of a cluster, summed
                for j, (k, end) in enumerate(zip(sizes, np.cumsum(sizes), strict=True)):
                    n, r, s = met[end - k : end], reach[:, end - k : end], slots[:, j] - (end - k)
                    i = np.arange(len(s))
                    far = 1 - r / np.maximum(n, 1)
                    far[:, n == 0] = np.inf
                    inner = (n[s] - r[i, s]) / np.maximum(n[s] - 1, 1)
                    far[i, s] = np.inf
                    outer = far.min(axis=1)
                    fine = (n[s] > 1) & np.isfinite(outer)
                    scale = np.where(fine, np.maximum(inner, outer), 1)
                    score = np.where(fine & (scale > 0), (np.where(fine, outer, 0) - inner) / np.where(scale > 0, scale, 1), 0)
                    total[j] += int(np.rint(score * _ONE).astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(total)], names=["j", "total"])

    parts = rows.select("at", "weight").mapInArrow(run, "j int, total long").groupBy("j").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("t"))
    totals = {r.j: r.t for r in parts.collect()}
    return [totals.get(j, 0.0) / _ONE / max(met[:k].sum() if not j else met[sum(sizes[:j]) : sum(sizes[: j + 1])].sum(), 1) for j, k in enumerate(sizes)]


def assign(rows: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, similarity): the nearest centroid and the cosine to it, within 0 and 1, rounded to 4 decimals."""
    size = np.maximum(np.sqrt((centroids * centroids).sum(axis=1)), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, places, weights, begins in _pieces(batch):
                reach = _products(places, weights, begins, centroids)
                slot = _choose(reach, centroids, [len(centroids)])[:, 0]
                length = np.sqrt(np.add.reduceat(weights * weights, begins))
                near = np.clip(reach[np.arange(len(slot)), slot] / (size[slot] * length), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.array(slot.astype(np.int32)), pa.array(near)], names=[key, "cluster", "similarity"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, cluster int, similarity double").withColumn("similarity", F.round("similarity", 4))


def topics(docs: DataFrame, key: str, text_col: str = "text", k: int | None = None, max_k: int = 8, seed: int = 42, min_silhouette: float = 0.035, max_words: int = 16_000, max_chars: int = 10_000) -> DataFrame:
    """(key, cluster, similarity) for each of ``docs``; those without a term are in cluster 0 with a similarity of 0."""
    rows = written(features(docs, key, text_col, max_words, max_chars), "features")
    width, n = max_words + max_chars, rows.count()
    if n == 0:
        return docs.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity"))
    if k is None and n == 2:
        a, b = (dict(zip(r["at"], r.weight, strict=True)) for r in rows.select("at", "weight").collect())
        k = 1 if sum(x * b.get(i, 0.0) for i, x in a.items()) >= SAME_TOPIC else 2
    if k is None and n > 2:
        found = fit(rows, key, list(range(2, min(max(2, max_k), n - 1) + 1)), width, seed)
        best = max(((round(s, 9), -len(c)) for s, c in zip(silhouettes(rows, found), found, strict=True)))
        centroids = next(c for c in found if len(c) == -best[1]) if best[0] >= min_silhouette else fit(rows, key, [1], width, seed)[0]
    else:
        centroids = fit(rows, key, [min(k or 1, n)], width, seed)[0]
    out = assign(rows, key, centroids)
    zero = docs.select(key).join(out.select(F.col(key)), key, "left_anti").select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity"))
    return out.unionByName(zero)
