"""Centroid clustering in whole numbers: screened in single precision, decided exactly.

Components become floor(scale * x). A fixed number of rounds assigns each vector to its nearest centroid (squared Euclidean
distance, the lowest number among equals) and replaces each centroid that has vectors by the exact floor(sum / count) of its
vectors' components; then all are assigned once more.

Assigning takes |c|^2 - 2 x.c from one float32 matrix product a batch. Whatever the order of summation, a product of d terms
is off by at most g(d) * |x| * |c| with g(d) = d u / (1 - d u) and u = 2^-24, three roundings more where whole numbers have
to be rounded to float32; so each value lies in an interval of known width. Centroids whose interval begins behind the least
end are out. Where more than one is left, distances to these are computed in exact integers. Ties and near ties can't be
decided by rounding, then, and the result doesn't depend on the machine's matrix product.

Only the centroids (count x components, bounded by parameters) go out to the tasks and come back: each task adds up its
vectors by centroid, Spark adds up the tasks. The input is scanned once for each round and for the starting centroids.

Edge cases: vectors that aren't of ``width`` components, all of them neither null nor NaN nor infinite, are left out. Repeated
rows count each. Starting centroids are the vectors with the least sha256 of "1:<id>", equal hashes by their components; vectors without
an id are clustered, but start none. With fewer vectors than ``count`` there are fewer centroids; with no vector that has an id
there are no rows. Scaled components are held within +-10^27; distances and inertias that don't fit 64 bits are the
largest long. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch
from vellum.llm.topk import usable

#: Unit roundoff of float32, and the largest norm at which no product overflows it.
U, SAFE = 2.0**-24, 1e18
_HELD, _LONG = 10**27, 2**63 - 1
#: Components up to this keep sums of squares of differences exact in 64 bits, up to 2^17 of them.
_SMALL = 2**21


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python's integers where components are large."""
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(scale * flat), -float(_HELD), float(_HELD))
    if (np.abs(scaled) < _SMALL).all():
        return scaled.astype(np.int64)
    return np.frompyfunc(lambda x: max(-_HELD, min(_HELD, int(x))), 1, 1)(scaled)


def screen(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the centroids that may be the nearest one, from float32 products and their error bounds."""
    a, c = x.astype(np.float64), centroids.astype(np.float64)
    size_a, size_c = np.sqrt((a * a).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    if not max(size_a.max(initial=0), size_c.max(initial=0)) < SAFE:
        return np.ones((len(x), len(c)), dtype=bool)
    terms = x.shape[1] + 4
    product = (a.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    off = 2 * terms * U / (1 - terms * U) * size_a[:, None] * size_c
    # The rest is double precision: |c|^2, the sums below and the norms in ``off``.
    off = off * (1 + 1e-9) + 1e-12 * (size_c * size_c + size_a[:, None] * size_c)
    near = size_c * size_c - 2 * product
    return near - off <= (near + off).min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, exact squared distance, distances that had to be computed exactly) for each row."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    may = screen(x, centroids)
    left = may.sum(axis=1)
    number = may.argmax(axis=1)
    rows, cols = np.nonzero(may & (left > 1)[:, None])
    if len(rows):
        gap = x[rows] - centroids[cols]
        exact = (gap * gap).sum(axis=1)
        order = np.lexsort((cols, _ordered(exact), rows))  # the first of each row is the least, then the lowest number
        rows, cols = rows[order], cols[order]
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        number[rows[first]] = cols[first]
    gap = x - centroids[number]
    return number, (gap * gap).sum(axis=1), np.where(left > 1, left, 0)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Ranks of integers of any size, equal ones alike."""
    return values if values.dtype != object else np.unique(values, return_inverse=True)[1]


def _rows(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, whole(np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, width), scale)


def _sums(centroids: np.ndarray, width: int, scale: int):
    """Vectors -> (number, at, total) of a task: sums of components by centroid, and at -1 how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, x in _rows(batches, width, scale):
            number, _, _ = nearest(x, centroids)
            for i in np.unique(number):
                part = x[number == i]
                n, sums = total.get(int(i), (0, 0))
                total[int(i)] = (n + len(part), sums + part.sum(axis=0).astype(object))
        flat = [(i, at, int(t)) for i, (n, sums) in total.items() for at, t in enumerate([n, *sums], -1)]
        cols = [[r[c] for r in flat] for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.decimal128(38, 0))], names=["number", "at", "total"])

    return run


def _assigned(centroids: np.ndarray, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, width, scale):
            number, far, exact = nearest(x, centroids)
            held = pa.array([min(int(d), _LONG) for d in far] if far.dtype == object else far, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), held, pa.array(exact.astype(np.int32))], names=["id", "number", "distance", "exact"])

    return run


def starting_centroids(rows: DataFrame, count: int, scale: int) -> np.ndarray:
    order = [F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), F.transform("v", lambda x: F.floor(scale * x)), F.col("v")]
    first = rows.where("id IS NOT NULL").orderBy(*order).limit(count).select("v").collect()
    return _matrix([whole(np.array(r.v, dtype=np.float64), scale).tolist() for r in first])


def _matrix(values: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < _SMALL for row in values for v in row)
    return np.array(values, dtype=np.int64 if small else object)


def cluster(
    vectors: DataFrame, count: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """((id, number, distance, exact) for each vector that is kept, the final centroids); see the module.

    ``exact`` is the number of distances that intervals left open and that were computed exactly.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    rows = rows.where((F.size("v") == width) & usable(F.col("v")))
    centroids = starting_centroids(rows, count, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "id long, number int, distance long, exact int"), []
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centroids, width, scale), "number int, at int, total decimal(38,0)")
        totals = {(r.number, r["at"]): int(r.t) for r in sums.groupBy("number", "at").agg(F.sum("total").alias("t")).collect()}
        after = centroids.tolist()
        for i in {n for n, _ in totals}:
            after[i] = [totals[i, at] // totals[i, -1] for at in range(width)]
        centroids = _matrix(after)
    return rows.mapInArrow(_assigned(centroids, width, scale), "id long, number int, distance long, exact int"), centroids.tolist()


def report(found: DataFrame, centroids: list[list[int]], scratch: Scratch) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256: the digest of the centroid's components, joined by commas."""
    if not centroids:
        zero = F.lit(0).cast("long")
        return found.select("*", zero.alias("cluster_inertia"), zero.alias("inertia"), F.lit("").alias("centroid_sha256"))
    rows = scratch.write(found, "assigned")
    sums = {r.number: int(r.t) for r in rows.groupBy("number").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()}
    held = [min(sums.get(i, 0), _LONG) for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.select(
        "*",
        F.get(F.array(*[F.lit(x).cast("long") for x in held]), F.col("number")).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), _LONG)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("number")).alias("centroid_sha256"),
    )
