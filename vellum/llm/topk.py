"""Exact top-k search by inner product through a pivot-distance index.

Vectors become whole numbers, floor(scale * x). The index is a written table: each vector's nearest pivot and its distance
from it, sorted by both, so that runs of rows are annuli around a pivot. A search goes over blocks of queries in two rounds:

1. each query meets the annulus that its own distance falls into, which gives it k scores to beat;
2. the annuli around every pivot are expanded outwards from the query's distance, until the triangle inequality rules the
   next one out: |q - x| >= |d(q, p) - d(x, p)|, so q.x <= (|q|^2 + |x|^2 - (d(q, p) - d(x, p))^2) / 2, which has to
   reach the k-th score so far. The scan leaves out the distances that no query of the block can need.

Pivots are fitted on a sample of at most ``PIVOT_SAMPLE`` rows (the first by hash); every row is indexed, and results don't
depend on the pivots. A block of queries holds about ``block`` rows, however many queries there are; tasks keep k rows for each
query of a block. Equal vectors lie at one distance and are split by row number, so no task holds a whole group of copies.

Edge cases: vectors that are null or hold null, NaN or infinite components (or components whose product with the scale is
infinite) take no part. Vectors of different lengths count as padded with zeros, so an empty one scores 0 with all.
Rows without an id take part as candidates, behind those with ids among equal scores. Rows are told apart by a
number of their own: of two rows with one id each is the other's candidate, and each gets its own k rows as a query.
Scores are exact for components of any size; those beyond 64 bits are reported, and ranked, as the largest or least long.
An empty table, or one without queries, gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, partitions

#: Rows on which pivots are fitted, and pivots at most.
PIVOT_SAMPLE, PIVOTS = 4096, 64
#: Rows of an annulus at most; queries of a block and their bytes, about.
ANNULUS, QUERY_BLOCK, BLOCK_BYTES = 512, 4096, 8 << 20
#: Whole numbers up to here are exact as doubles, products and sums of products included.
EXACT = float(2**52)
_LONG = (-(2**63), 2**63 - 1)


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers -> a matrix of doubles, padded with zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def fit_pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """Centres of a few rounds of k-means from farthest-first seeds, in whole numbers; at least one."""
    sample = sample[(np.abs(sample) < 2**20).all(axis=1)]
    if not len(sample):
        return np.zeros((1, 1))
    chosen, far = [0], _squares(sample, sample[:1])[:, 0]
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _squares(sample, sample[chosen[-1:]])[:, 0])
    centres = sample[chosen].copy()
    for _ in range(rounds):
        nearest = _squares(sample, centres).argmin(axis=1)
        for i in np.unique(nearest):
            centres[i] = np.rint(sample[nearest == i].mean(axis=0))
    return np.unique(centres, axis=0)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both to the width of the narrower one: what is beyond it meets zeros."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances."""
    x, y = _common(a, b)
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (x @ y.T), 0)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles while these are exact, else Python's integers held within 64 bits."""
    a, b = _common(q, x)
    with np.errstate(over="ignore"):
        top = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    held = np.frompyfunc(lambda s: min(max(int(s), _LONG[0]), _LONG[1]), 1, 1)
    return held(np.dot(whole(a), whole(b).T) if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)).astype(np.int64)


def build(vectors: DataFrame, id_col: str, vector_col: str, scale: int, is_query: Column, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """The written index, (pivot, dist, norm, uid, id, q, v) sorted by pivot and distance, and the pivots; norms are squared."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
        F.transform(vector_col, lambda x: x.cast("double")).alias("v"),
    ).where(usable(F.col("v")))
    picked = rows.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).select("v").toArrow()["v"].combine_chunks()
    with np.errstate(over="ignore"):
        pivots = fit_pivots(np.floor(scale * matrix(picked)) if len(picked) else np.zeros((0, 1)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * np.asarray(v.flatten(), dtype=np.float64))
                offsets = np.concatenate([[0], np.cumsum(np.asarray(v.value_lengths()))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))
                m = matrix(lists)
                far = np.sqrt(_squares(m, pivots))
                norm = (m * m).sum(axis=1)
            nearest = np.nan_to_num(far, nan=np.inf).argmin(axis=1)
            out = [nearest.astype(np.int32), far[np.arange(len(m)), nearest], norm, batch.column("id"), batch.column("q"), lists]
            fine = pa.array(np.isfinite(m).all(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["pivot", "dist", "norm", "id", "q", "v"]).filter(fine)

    index = rows.mapInArrow(keyed, "pivot int, dist double, norm double, id long, q boolean, v array<double>").withColumn("uid", F.monotonically_increasing_id())
    parts = partitions(vectors.sparkSession)
    spread = index.repartitionByRange(parts, "pivot", "dist", "uid").sortWithinPartitions("pivot", "dist", "uid")
    return scratch.write(spread, "index"), pivots


class _Best:
    """The best k rows of each query so far, as sorted arrays."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.score = np.full((len(floor), k), _LONG[0])
        self.rank = np.full((len(floor), k, 2), _LONG[1])  # no id, id
        self.uid = np.full((len(floor), k), -1)

    def add(self, at: np.ndarray, scores: np.ndarray, nameless: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Columns of ``scores`` are candidates in the order of (nameless, ids); rows are the queries ``at``."""
        k = min(self.k, scores.shape[1])
        # The k best, the first ones among equal scores: a cut by the k-th score, then the columns in order.
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        above, equal = scores > least[:, None], scores == least[:, None]
        take = above | (equal & (np.cumsum(equal, axis=1) <= (k - above.sum(axis=1))[:, None]))
        pick = np.nonzero(take)[1].reshape(len(at), k)
        found = np.take_along_axis(scores, pick, axis=1)
        score = np.concatenate([self.score[at], found], axis=1)
        rank = np.concatenate([self.rank[at], np.stack([nameless[pick], ids[pick]], axis=2)], axis=1)
        uid = np.concatenate([self.uid[at], uids[pick]], axis=1)
        own = uid < 0
        order = np.lexsort((rank[:, :, 1], rank[:, :, 0], ~score, own), axis=1)[:, : self.k]
        self.score[at] = np.take_along_axis(score, order, axis=1)
        self.rank[at] = np.take_along_axis(rank, order[:, :, None], axis=1)
        self.uid[at] = np.take_along_axis(uid, order, axis=1)
        full = self.uid[at, -1] >= 0
        self.floor[at] = np.where(full, np.maximum(self.floor[at], self.score[at, -1]), self.floor[at])


def _search(block: dict[str, np.ndarray], k: int, seeds: bool):
    """A task: annuli of the sorted index -> for each query of the block the best k rows that reach its floor."""
    q, uid, to_pivot, floor, nearest, own = (block[n] for n in ("v", "uid", "to_pivot", "floor", "nearest", "own"))
    norm = block["norm"]

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            pivot = np.asarray(batch.column("pivot"))
            cuts = np.flatnonzero(np.diff(pivot)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pivot)], strict=True):
                for at in range(lo, hi, ANNULUS):
                    yield batch.slice(at, min(ANNULUS, hi - at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, met = _Best(floor, k), 0
        for piece in annuli(batches):
            p, dist = piece.column("pivot")[0].as_py(), np.asarray(piece.column("dist"))
            lo, hi, x = dist[0], dist[-1], matrix(piece.column("v"))
            top = np.asarray(piece.column("norm")).max()
            exact = max(top, norm.max(initial=0)) < EXACT / 4
            d = to_pivot[:, p]
            if seeds:
                open_ = (nearest == p) & (lo <= own) & (own <= hi)
            elif exact:
                gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                bound = (norm + top - gap * gap) / 2
                open_ = bound * (1 + 1e-9) + 1 >= best.floor  # more than what rounding can take away
            else:
                open_ = np.full(len(q), True)
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            met += len(at) * len(x)
            ids = piece.column("id")
            nameless = np.asarray(ids.is_null()).astype(np.int64)
            names, rows = np.asarray(ids.fill_null(0)), np.asarray(piece.column("uid"))
            order = np.lexsort((names, nameless))
            scores = _scores(q[at], x[order])
            alone = rows[order] == uid[at][:, None]
            scores[alone] = _LONG[0]
            better = scores.max(axis=1) >= best.floor[at]
            at, scores, alone = at[better], scores[better], alone[better]
            has = alone.any(axis=1)
            if len(order) and (~has).any():
                best.add(at[~has], scores[~has], nameless[order], names[order], rows[order])
            for i in np.flatnonzero(has):  # the queries that lie in this annulus themselves
                if (others := ~alone[i]).any():
                    best.add(at[i : i + 1], scores[i : i + 1, others], nameless[order][others], names[order][others], rows[order][others])
        i, j = np.nonzero((best.uid >= 0) & (best.score >= floor[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid[i]), pa.array(best.rank[i, j, 1], mask=best.rank[i, j, 0] == 1), pa.array(best.uid[i, j]), pa.array(best.score[i, j]), pa.array(np.full(len(i), 0))],
            names=["quid", "id", "uid", "score", "met"],
        )
        yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.int64()) for x in (None, None, None, None, met)], names=["quid", "id", "uid", "score", "met"])

    return run


_FOUND = "quid long, id long, uid long, score long, met long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("quid").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return found.where("quid IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reach(block: dict[str, np.ndarray], most: float) -> Column:
    """A filter for the scan: the distances from each pivot that some query of the block can't rule out."""
    norm, d, out = block["norm"], block["to_pivot"], F.lit(False)
    if max(most, norm.max(initial=0)) >= EXACT / 4:
        return F.lit(True)
    wide = np.sqrt(np.maximum((norm + most) * (1 + 1e-9) + 4 - 2 * block["floor"].astype(np.float64) * (1 - 1e-9), 0)) + 1
    for p in range(d.shape[1]):
        out = out | ((F.col("pivot") == p) & F.col("dist").between(float((d[:, p] - wide).min()), float((d[:, p] + wide).max())))
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, id, score, met) for the rows where ``is_query`` holds against all others; see the module.

    ``met`` is the number of pairs that the second round of the query's block scored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    index, pivots = build(vectors, id_col, vector_col, scale, is_query, scratch)
    shells = index.groupBy("pivot").agg(F.count(F.lit(1)), F.min("dist"), F.max("dist"), F.max("norm"), F.max(F.size("v"))).collect()
    most = max((r[4] for r in shells), default=0.0)
    # The breadth of about two annuli at each pivot.
    breadth = {r[0]: 2 * ANNULUS * (r[3] - r[2]) / r[1] for r in shells}
    asked = scratch.write(index.where("q"), "queries")
    total = asked.count()
    block = max(1, min(block, BLOCK_BYTES // (8 * (len(pivots) + max((r[5] for r in shells), default=0)))))
    blocks = max(1, -(-total // block))
    if blocks > 1:  # near ones together
        parts = asked.repartitionByRange(blocks, "pivot", "dist", "uid").withColumn("block", F.spark_partition_id())
        asked = scratch.write(parts, "blocks")
    results = []
    for b in range(blocks):
        rows = (asked.where(F.col("block") == b) if blocks > 1 else asked).select("uid", "pivot", "dist", "norm", "v").toArrow()
        if not rows.num_rows:
            continue
        q = matrix(rows["v"].combine_chunks())
        with np.errstate(over="ignore", invalid="ignore"):
            to_pivot = np.sqrt(_squares(q, pivots))
        held = {"v": q, "uid": rows["uid"].to_numpy(), "to_pivot": to_pivot, "nearest": rows["pivot"].to_numpy(), "own": rows["dist"].to_numpy(), "norm": rows["norm"].to_numpy()}
        held["floor"] = np.full(len(q), _LONG[0])
        near = F.lit(False)
        for p in np.unique(held["nearest"]):
            own = held["own"][held["nearest"] == p]
            near = near | ((F.col("pivot") == int(p)) & F.col("dist").between(float(own.min()) - breadth[p], float(own.max()) + breadth[p]))
        seeds = _ranked(index.where(near).mapInArrow(_search(held, k, True), _FOUND), k)
        kth = seeds.where(F.col("rank") == k).select("quid", "score").toArrow()
        place = {u: i for i, u in enumerate(held["uid"].tolist())}
        at = [place[u] for u in kth["quid"].to_pylist()]
        held["floor"][at] = kth["score"].to_numpy()
        found = scratch.write(index.where(_reach(held, most)).mapInArrow(_search(held, k, False), _FOUND), "found")
        met = found.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]
        results.append(_ranked(found, k).withColumn("met", F.lit(met).cast("long")))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long, met long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    named = asked.select(F.col("uid").alias("quid"), F.col("id").alias("query_id"))
    return out.join(named, "quid").select("query_id", "rank", "id", "score", "met")
