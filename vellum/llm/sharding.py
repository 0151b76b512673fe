"""Weighted rendezvous hashing of stable record keys (operator 3). Law: ``key``.

Every shard gets a score from the record's key and the shard's number; the greatest score wins. With a uniform hash u
in (0, 1) a shard of weight w scores -w / ln u, which deals out keys in proportion to the weights. A new shard
changes no other score: it takes records into itself only, and a shard that goes gives up its own only. The
decision uses the key alone, so it needs no shuffle and comes out alike on any cluster.

Slots number a shard's records from 0, ordered by the MD5 of the key and then the key, size and checksum. They
are counted bucket by bucket (the digest's first three hex digits), so no task sorts a shard.

Edge cases. A null key is a key of its own. A null text has size 1 (as an empty one) and the checksum of nothing. Rows
with equal keys share a shard; their slots differ. A very long text is read once, for its size and checksum. An empty table gives an empty result. Extra columns stay, whatever their
names; only those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import dense_rank_by_bucket, fresh

BUCKETS = 4096


def _key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(col).cast("string")), F.lit("null"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a string key. Shards of weight 0 get nothing."""
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            h = F.xxhash64(F.concat(key, F.lit(f"/{shard}")))
            u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
            scores.append(F.struct((-F.lit(float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("minus")))
    if not scores:
        raise ValueError("one weight at least must be over 0")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus"]).cast("int")


def assign(docs: DataFrame, shards: int | list[float] = 16, key_col: str = "doc_id", text_col: str = "text", grown: int | None = None) -> DataFrame:
    """``docs`` with _size, _crc32, _shard, _slot and _grown: the shard with ``grown`` shards of weight 1 (one more, if None)."""
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    more = weights + [1.0] * ((grown or len(weights) + 1) - len(weights))
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = _key(key_col)
    docs = docs.drop("_size", "_crc32", "_shard", "_slot", "_grown")
    (digest,) = fresh(docs, "_digest")
    rows = docs.withColumns(
        {
            "_size": (F.octet_length(data) + 1).cast("long"),
            "_crc32": F.crc32(data),
            "_shard": rendezvous(key, weights),
            "_grown": rendezvous(key, more),
            digest: F.md5(key),
        }
    )
    bucket = F.conv(F.substring(digest, 1, 3), 16, 10)
    order = [F.col(digest), F.col(key_col), F.col("_size"), F.col("_crc32")]
    return dense_rank_by_bucket(rows, ["_shard"], bucket, order, "_slot").drop(digest)
