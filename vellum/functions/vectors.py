"""Vector arithmetic on arrays, in double precision; built-in functions but for the counts of hashed_embedding()."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0 if either norm is 0. Norms that are known already aren't computed for each pair again."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def _folded(dimension: int):
    def fold(hashes: pa.Array) -> pa.Array:
        n, flat = len(hashes), np.asarray(hashes.flatten(), dtype=np.int64)
        row = np.repeat(np.arange(n), np.asarray(hashes.value_lengths().fill_null(0)))
        raw = np.bincount(row * dimension + flat % dimension, weights=np.where(flat >= 0, 1.0, -1.0), minlength=n * dimension).astype(np.float64).reshape(n, dimension)
        size = np.sqrt((raw * raw).sum(axis=1))[:, None]
        values = np.divide(raw, size, out=np.zeros_like(raw), where=size > 0).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), pa.array(values), mask=hashes.is_null())

    return F.arrow_udf(fold, "array<double>")


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """Signed feature hashing of lower-case words, L2-normalised: the default embedder, needing no model. Counts are made a batch at a time."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+", -1), lambda w: w != "")
    return _folded(dimension)(F.transform(words, lambda w: F.xxhash64(w)))
