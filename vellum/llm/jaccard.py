"""Near-duplicates by the exact Jaccard similarity of word-shingle sets, 0.8 or more (near_dedup of the pipeline).

Two texts are linked if their sets of shingles (``simhash``'s, as 64-bit hashes) have a similarity of 4/5 or more; a class is a
connected component. Two sources of candidates; each candidate is verified by intersecting the two sets.

Before that, candidates meet by sketches: the parities of a set's hashes in two to four bits a shingle. Two sketches differ in no more
bits than the sets do in shingles, so what is too far apart by them needs no sets, and no link is lost. Only sets of the rest
are read from texts and dealt out: these are some of the near-duplicates' own, not of all texts that share a passage.

* Golay keys of SimHash fingerprints, as in operator 6. They miss most edited copies, but join large groups early.
* Prefix keys, which miss none: with all shingles in one order, sets of similarity 4/5 have a shingle in common among the
  first n // 5 + 1 of their n. The order is by frequency in a sample, then by hash, so that common passages come last. A
  pair that meets is dropped if its sizes, or the shingles after the place where it meets first, leave no room for 4/5.

Equal sets are one node from the start. Where a key is shared, its members are first compared with one hub of the bucket,
for some rounds while much is left; then all pairs of members that aren't in one class yet are compared. So a large group of near
copies costs about one comparison a member and key, and nothing is left out.

Edge cases. Texts without words have the empty set and are one class. A very long text is one set, read as a whole. Ids are whole
numbers (cast to long). All columns stay, whatever their names. A text of fewer words than a shingle is one shingle.
Rows without an id take part; a class keeps the row with the least id, or the least row key if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm import simhash
from vellum.llm.common import Scratch, components, fresh, redealt, row_keys

#: Sets whose shingles are counted for the order of prefixes, the least count that matters, and how many shingles at most.
SAMPLE, OFTEN, RANKED = 10_000, 10, 100_000
HUB_ROUNDS = 6


def _set(text: str | None, shingle: int) -> tuple[int, int, np.ndarray]:
    """Set key, fingerprint and hashes, in rising order, of one text."""
    h = simhash._hashes(text, shingle)
    distinct = np.unique(h)
    return xxhash.xxh64_intdigest(distinct.tobytes()), simhash.of_hashes(h), distinct.view(np.int64)


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _sketch(h: np.ndarray) -> bytes:
    """Parities of the hashes by their lowest bits: a power of two of bits, two for each hash at least."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount(h & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ once the longer one is folded: at most as many as there are hashes in one set alone."""
    u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, m, sketch of a, of b) -> (a, b) of those that may have a similarity of 4/5."""
    for batch in batches:
        total = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
        far = [_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(9 * np.array(far, dtype=np.int64) <= total))


def _prefixes(shingle: int, ranked: np.ndarray, counts: np.ndarray):
    """(id, row key, text) -> (id, row key, set key, fingerprint, size, sketch, prefix in its order)."""

    def prefix(h: np.ndarray) -> np.ndarray:
        if len(ranked) and len(h):
            near = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
            h = h[np.argsort(np.where(ranked[near] == h, counts[near], 0), kind="stable")]
        return h[: len(h) // 5 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                s, fp, sets = zip(*[_set(x.as_py(), shingle) for x in batch.column(2)], strict=True)
                columns = [batch.column(0), batch.column(1), _signed(s), _signed(fp), pa.array([len(h) for h in sets], pa.int32()), pa.array([_sketch(h) for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, _lists([prefix(h) for h in sets])], names=["id", "row_key", "s", "fp", "n", "sketch", "prefix"])

    return run


def _hashed(shingle: int):
    """(text) -> (set key, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                s, _, sets = zip(*[_set(x.as_py(), shingle) for x in whole.slice(at, 1000).column(0)], strict=True)
                yield pa.RecordBatch.from_arrays([_signed(s), _lists(list(sets))], names=["s", "hashes"])

    return run


def _ranked(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the sets, in rising order, and their counts."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod("row_key", F.lit(every)) == 0).select("text").mapInArrow(_hashed(shingle), "s long, hashes array<long>")
    counts = some.dropDuplicates(["s"]).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r.h, r.n) for r in counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(RANKED).collect())
    return np.array([h for h, _ in found], dtype=np.int64), np.array([n for _, n in found], dtype=np.int64)


def _room(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles that meet first at places i and j can have a similarity of 4/5."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))


class _Verifier:
    """Links among pairs of sets. Sets are made from texts when a pair first needs them, and kept for later rounds."""

    def __init__(self, scratch: Scratch, texts: DataFrame, rows: DataFrame, shingle: int):
        self.scratch, self.texts, self.shingle, self.sets = scratch, texts, shingle, []
        one = rows.groupBy("s").agg(F.min("row_key").alias("one"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        self.shapes = scratch.write(one, "shapes")

    def _made(self) -> DataFrame:
        out = self.sets[0]
        for more in self.sets[1:]:
            out = out.union(more)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        scratch = self.scratch
        pairs = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs")
        left = redealt(self.shapes.select("s", "n", F.col("sketch").alias("x")), "s", "_x")
        right = redealt(self.shapes.select("s", F.col("n").alias("m"), F.col("sketch").alias("y")), "s", "_y")
        both = pairs.join(left, F.col("a") == F.col("_x")).join(right, F.col("b") == F.col("_y"))
        both = both.where(5 * F.least("n", "m") >= 4 * F.greatest("n", "m")).select("a", "b", "n", "m", "x", "y")
        near = scratch.write(both.mapInArrow(_near, "a long, b long"), "near")
        scratch.drop(pairs)
        needed = near.select(F.col("a").alias("_s")).union(near.select("b")).distinct()
        if self.sets:
            needed = needed.join(redealt(self._made().select("s"), "s", "_m"), F.col("_s") == F.col("_m"), "left_anti")
        one = self.shapes.select("s", "one").join(redealt(needed, "_s", "_n"), F.col("s") == F.col("_n"), "left_semi")
        one = scratch.write(one.select("one"), "one")
        scratch.tidy()
        # Texts are smaller than hashes on their way; few keys go to the texts instead.
        found = self.texts.join(redealt(one, "one", "_k"), F.col("row_key") == F.col("_k"), "left_semi")
        self.sets.append(scratch.write(found.select("text").mapInArrow(_hashed(self.shingle), "s long, hashes array<long>"), "sets"))
        scratch.tidy()
        left = redealt(self._made().withColumnRenamed("hashes", "x"), "s", "_x")
        right = redealt(self._made().withColumnRenamed("hashes", "y"), "s", "_y")
        both = near.join(left, F.col("a") == F.col("_x")).join(right, F.col("b") == F.col("_y"))
        shared = F.size(F.array_intersect("x", "y"))
        # Rows that are equal may have brought a set twice.
        return both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b").distinct()

    def done(self) -> None:
        for table in [*self.sets, self.shapes]:
            self.scratch.drop(table)


def _classes(scratch: Scratch, texts: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, root): set keys of the classes of more than one set."""
    w = W.partitionBy("key")
    keyed = rows.select("s", "n", F.posexplode("prefix").alias("i", "key"))
    member = F.struct("s", "n", "i")
    keyed = keyed.withColumn("_lo", F.min(member).over(w)).withColumn("_hi", F.max(member).over(w)).withColumn("_m", F.count(F.lit(1)).over(w))
    room = _room(F.col("_lo.n"), F.col("_lo.i"), F.col("_hi.n"), F.col("_hi.i"))
    shared = keyed.where((F.col("_lo.s") < F.col("_hi.s")) & ((F.col("_m") > 2) | room))
    buckets = scratch.write(shared.select("key", "s", "n", "i").distinct(), "buckets")
    scratch.tidy()
    prints = rows.groupBy("fp").agg(F.min("s").alias("_least"))
    golay = simhash.link_fingerprints(scratch, prints.select("fp"))
    golay = golay.join(redealt(prints.withColumnRenamed("_least", "p"), "fp", "_a"), F.col("a") == F.col("_a"))
    golay = golay.join(redealt(prints.withColumnRenamed("_least", "q"), "fp", "_b"), F.col("b") == F.col("_b"))
    equal = rows.select("fp", "s").distinct().join(redealt(prints, "fp", "_fp"), F.col("fp") == F.col("_fp"))
    equal = equal.where("s <> _least").select(F.col("s").alias("a"), F.col("_least").alias("b"))
    pairs = scratch.write(golay.select(F.col("p").alias("a"), F.col("q").alias("b")).union(equal), "golay")
    scratch.tidy()
    verifier = _Verifier(scratch, texts, rows, shingle)
    scratch.tidy()

    left = buckets.withColumn("root", F.col("s"))
    links, last = None, None
    for k in range(HUB_ROUNDS + 1):
        of = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
        todo = of.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0
        all_pairs = k == HUB_ROUNDS or (k and (todo <= 10 * last[1] or todo > 0.8 * last[0]))
        if all_pairs:
            one, two = left.alias("u"), redealt(left, "key", "_k").alias("v")
            met = one.join(two, (F.col("u.key") == F.col("v._k")) & (F.col("u.s") < F.col("v.s")) & (F.col("u.root") != F.col("v.root")))
            met = met.where(_room(F.col("u.n"), F.col("u.i"), F.col("v.n"), F.col("v.i"))).select(F.col("u.s").alias("a"), F.col("v.s").alias("b"))
        else:
            hub = F.min_by(F.struct("s", "n", "i", "root"), F.xxhash64("s", F.lit(k))).over(w)
            met = left.withColumn("h", hub).where("root <> h.root")
            met = met.where(_room(F.col("n"), F.col("i"), F.col("h.n"), F.col("h.i"))).select(F.col("s").alias("a"), F.col("h.s").alias("b"))
        found = verifier.links(met.union(pairs) if not k else met)
        links = scratch.write(found if links is None else found.union(links), "links")
        scratch.tidy()
        roots = scratch.write(components(scratch, links), "roots")
        if all_pairs:
            verifier.done()
            scratch.drop(buckets)
            return roots
        last = (todo, buckets.count() if not k else last[1])
        named = buckets.join(redealt(roots.withColumnRenamed("root", "_root"), "node", "_n"), F.col("s") == F.col("_n"), "left")
        named = named.select("key", "s", "n", "i", F.coalesce("_root", "s").alias("root"))
        open_ = named.withColumn("_lo", F.min("root").over(w)).withColumn("_hi", F.max("root").over(w)).where("_lo < _hi")
        left = scratch.write(open_.drop("_lo", "_hi"), "left")
        scratch.tidy()
    raise AssertionError


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id, the first of equal rows. All columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    scratch.tidy()
    key, key2 = row_keys(id_col, text_col)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("row_key"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.mapInArrow(_prefixes(shingle, *_ranked(texts, shingle)), "id long, row_key long, s long, fp long, n int, sketch binary, prefix array<long>")
    rows = scratch.write(rows, "rows")
    roots = redealt(_classes(scratch, texts, rows, shingle), "node", "_n")
    found = rows.select("id", "row_key", "s").join(roots, F.col("s") == F.col("_n"), "left")
    best = found.groupBy(F.coalesce("root", "s").alias("c")).agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row_key").alias("k"))).alias("b")
    )
    k, k2 = fresh(docs, "_key", "_key2")
    keep = best.select(F.col("b.k").alias(k)).distinct()
    # Rows that are equal in id and text share both keys; others that share one by chance are told apart by the second.
    return docs.withColumn(k, key).withColumn(k2, key2).join(keep, k, "left_semi").dropDuplicates([k, k2]).drop(k, k2)
