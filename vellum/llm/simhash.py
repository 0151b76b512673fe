"""SimHash near-duplicates, found with Golay-code fuzzy hashing (operator 6).

A text's fingerprint has 64 bits: bit k is 1 if it is set in over half of the hashes of the text's word
shingles. Fingerprints that differ in at most four bits are linked; a class is a connected component.

Search. The 64 bits are three segments of 22, 21 and 21 bits, each a (shortened) word of the Golay code.
Sort a pair's errors by segment: with at most four in all, the largest is two or more or the rest are nil, and
the two smaller ones are (0,0), (0,1), (1,1) or (0,2). So a pair meets under one of two kinds of keys:

* two segments with at most one error each: the one's decoded index with each key of the other, and the
  reverse on the other side (kinds 0 to 2);
* one equal segment, and the next one, in a ring, with at most two errors: the equal bits with each
  key of the next one (kinds 3 to 5).

That is some 48 short keys for each distinct fingerprint. Equal fingerprints are one row from the start, so
copies cost nothing. Within a bucket, pairs are verified by counting bits, and only a spanning forest of
its links leaves the task: at most one link for each member. A bucket of more than ``block`` members is cut into
blocks, and each pair of blocks is one unit of work, so that no task holds a whole hot bucket.

Edge cases. Null and empty texts, and texts of break characters only, have fingerprint zero and link like any
other. A text of fewer words than a shingle is one shingle, a very long one is hashed as a whole. Ids are whole numbers (cast to
long). Rows without an id take part; ``component_id``
is the least id that is not null, null if there is none. Repeated rows stay rows of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import golay
from vellum.llm.common import Scratch, components, fresh, partitions, redealt, row_keys

#: Lowest bit and bits of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 4
SEED = 42


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = shingle - 1
    return np.fromiter(
        (h(joined[a:b], SEED) for a, b in zip(starts[:-last or None].tolist(), ends[last:].tolist(), strict=True)),
        dtype=np.uint64,
        count=len(words) - last,
    )


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return of_hashes(_hashes(text, shingle))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of the shingles with these hashes."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    pad = np.concatenate([h, np.zeros(-n % 255, dtype=np.uint64)]).reshape(-1, 255)
    for k in range(8):  # eight bits, one of each byte, are counted at a time
        sums = ((pad >> np.uint64(k)) & lanes).sum(axis=1, dtype=np.uint64)
        counts[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > n)
    return int(sum(1 << int(b) for b in bits))


def fingerprint_column(text: str, shingle: int):
    """A column of fingerprints, as signed longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), dtype=np.uint64, count=len(texts))
        return pa.array(out.view(np.int64))

    return of(F.col(text))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (key, side, fp). Sides meet 0 with 1; side 2 meets itself."""
    for batch in batches:
        all_fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(all_fp), 20_000):
            fp = all_fp[at : at + 20_000]
            u = fp.view(np.uint64)
            seg = [((u >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.uint32) for low, n in SEGMENTS]
            own = [golay.decode(s).astype(np.int64) for s in seg]
            near = [golay.keys(s) for s in seg]
            out = []
            for kind, (x, y) in enumerate(((0, 1), (1, 2), (2, 0))):
                row, key = near[y]
                out.append((kind << 48 | own[x][row] << 12 | key, 0, row))
                row, key = near[x]
                out.append((kind << 48 | key.astype(np.int64) << 12 | own[y][row], 1, row))
                row, key = near[y]
                out.append(((kind + 3) << 48 | seg[x][row].astype(np.int64) << 12 | key, 2, row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([k for k, _, _ in out])),
                    pa.array(np.concatenate([np.full(len(r), s, dtype=np.int8) for _, s, r in out])),
                    pa.array(np.concatenate([fp[r] for _, _, r in out])),
                ],
                names=["key", "side", "fp"],
            )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_DISTANCE


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of ``u`` and ``v`` (uint64; may be the same array) that join all that the links join.

    A member is compared with all that are not yet in its class, so that a class that is found early is not
    compared within itself again.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = at[: len(u)], np.unique(at[len(u) :])
    label = np.arange(len(nodes))
    members: dict[int, list[int]] = {}
    out = []
    for i in np.unique(left):
        mine = label[i]
        others = right[label[right] != mine]
        hit = others[_near(nodes[others], nodes[i])]
        if not len(hit):
            continue
        for other in np.unique(label[hit]):
            j = hit[np.flatnonzero(label[hit] == other)[0]]
            out.append((int(nodes[i]), int(nodes[j])))
            a, b = label[i], other
            if len(members.get(a, (a,))) < len(members.get(b, (b,))):
                a, b = b, a
            moved = members.pop(b, [b])
            label[moved] = a
            members.setdefault(a, [a]).extend(moved)
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, unit, side, fp), sorted by key and unit -> links (a, b). A bucket may cross batches."""
    names = ["key", "unit", "side", "fp"]

    def links(k, unit, side, fp):
        change = np.flatnonzero((k[1:] != k[:-1]) | (unit[1:] != unit[:-1])) + 1
        bounds = np.concatenate([[0], change, [len(k)]])
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            s, f = side[lo:hi], fp[lo:hi].view(np.uint64)
            u, v = (f, f) if s[0] == 2 and s[-1] == 2 else (f[(s == 0) | (s == 3)], f[(s == 1) | (s == 4)])
            if len(u) and len(v):
                if len(u) == 1 and len(v) == 1:
                    found = [(int(u[0]), int(v[0]))] if u[0] != v[0] and np.bitwise_count(u[0] ^ v[0]) <= MAX_DISTANCE else []
                else:
                    found = forest(u, v)
                for x, y in found:
                    a.append(x)
                    b.append(y)
        ends = [np.array(x, dtype=np.uint64).view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        k, unit = now[0], now[1]
        cut = len(k) - int(np.argmax((k[::-1] != k[-1]) | (unit[::-1] != unit[-1]))) if (k[0] != k[-1] or unit[0] != unit[-1]) else 0
        held = [x[cut:].copy() for x in now]
        if cut:
            yield links(*[x[:cut] for x in now])
    if held is not None:
        yield links(*held)


def _spread(rows: DataFrame) -> DataFrame:
    """(key, side, fp, k), k the blocks of the key's bucket -> a row for each pair of blocks that holds the member's.

    In a pair of two blocks, the first one's members of side 2 act as side 3, the second one's as side 4.
    """
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn(
            "side",
            F.when((F.col("side") != 2) | (i == j), F.col("side")).when(F.col("own") == i, 3).otherwise(4).cast("byte"),
        )
        .select("key", "side", "fp", (1 + i * F.col("k") + j).cast("int").alias("unit"))
    )


def link_fingerprints(scratch: Scratch, prints: DataFrame, block: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints`` (fp long): a forest for each bucket of keys."""
    n = partitions(prints.sparkSession)
    keyed = prints.mapInArrow(_keyed, "key long, side byte, fp long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = scratch.write(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("k")), "hot")
    rows = keyed.withColumn("unit", F.lit(0))
    if not hot.isEmpty():
        rows = rows.join(hot.select("key"), "key", "left_anti").unionByName(_spread(keyed.join(hot, "key")))
    return (
        rows.repartition(n, "key", "unit")
        .sortWithinPartitions("key", "unit", "side")
        .select("key", "unit", "side", "fp")
        .mapInArrow(_linked, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, block: int = 20_000) -> DataFrame:
    """(id, fp, row_key, component_id) for each row of ``docs``; see the module for the edge cases.

    ``row_key`` is a 64-bit key of id and text by which rows can be found again.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(
        docs.select(
            F.col(id_col).cast("long").alias(id_col),
            fingerprint_column(text_col, shingle).alias("fp"),
            F.xxhash64(id_col, text_col).alias("row_key"),
        ),
        "prints",
    )
    least = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    prints = scratch.write(least, "distinct")
    edges = link_fingerprints(scratch, prints.select("fp"), block)
    roots = components(scratch, edges)
    linked = scratch.write(prints.join(redealt(roots, "node", "fp"), "fp"), "linked")
    ids = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    inner = linked.join(redealt(ids, "root", "_root"), F.col("root") == F.col("_root"))
    alone = prints.join(linked.select("fp"), "fp", "left_anti")
    by_print = inner.select("fp", "component_id").union(alone.select("fp", "_least"))
    return rows.join(by_print, "fp", "left").select(id_col, "fp", "row_key", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id, the first of equal rows.

    All columns stay as they are. A class of rows without ids keeps the row with the least row key.
    """
    found = near_duplicates(docs, id_col, text_col, shingle)
    # Rows of one class share component_id, but for classes without ids: those go by their fingerprint.
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_p")).agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("row_key").alias("k"))).alias("b")
    )
    k, k2 = fresh(docs, "_key", "_key2")
    keys = row_keys(id_col, text_col)
    keep = best.select(F.col("b.k").alias(k)).distinct()
    kept = docs.withColumn(k, keys[0]).withColumn(k2, keys[1]).join(keep, k, "left_semi")
    return kept.dropDuplicates([k, k2]).drop(k, k2)
