"""Benchmark decontamination with suffix arrays of the training shards (operator 5).

The test set is the small side: its words get ids, and its suffixes are searched. A window is so many consecutive words of
one item, or a whole item that is shorter: the beginning of a test suffix. Training text is dealt with shard by shard, a shard being a run of
whole documents inside one task. A shard's words become ids, 0 for a word that no item has, and its suffix array holds
every suffix that starts with at least ``min_match`` words of the test set (no other can match that many).
All test suffixes are binary-searched at once, by their windows: an interval of the array holds every location
of one. Each location found so is then carried on to its longest verbatim match, by binary search in the
sorted suffixes of the test set. A document lies in one shard, so nothing is shuffled.

The test set is collected in blocks of at most ``max_bytes`` of text; each block is broadcast and scanned by itself, and what it found
is written before the next block's turn, so that more blocks mean more passes, not more memory. A block takes some 30 bytes a byte of text.

Edge cases. Null and empty texts have no words. Items whose id or text is null, and items without words, hold no
window. Items with the same id count once. Repeated rows are judged each on its own. A very long text is a shard by itself,
in arrays of its words. Extra columns are carried along untouched by ``drop_contaminated``, whatever their names, and left out by
``find_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

#: Bytes that are no part of a word: all of ASCII but digits and letters.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TABLE).split()


class TestSet:
    """One block of items: the ids of its words, its distinct windows with the items that have them, and its sorted suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list = []
        parts, sizes = [], []
        for item_id, text in items:
            words = words_of(text)
            if item_id is None or not words:
                continue
            self.items.append(item_id)
            parts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32))
            parts.append(np.full(1, -1, dtype=np.int32))
            sizes.append(len(words))
        #: All words, -1 after each item; where each item begins.
        self.words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        sizes = np.array(sizes, dtype=np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        #: Bits of a word id: four words are one number, or two if there are very many words.
        self.bits = 16 if len(self.vocabulary) < 1 << 16 else 32
        self._windows(sizes, window)
        self.suffixes = self._sorted()

    def _windows(self, sizes: np.ndarray, window: int) -> None:
        wide = key_words(window, self.bits)
        counts = np.maximum(1, sizes - window + 1)
        item = np.repeat(np.arange(len(sizes)), counts)
        at = self.begins[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        length = np.minimum(sizes[item], window)
        padded = np.concatenate([self.words, np.zeros(wide, dtype=np.int32)])
        inside = np.arange(wide) < length[:, None]
        low = _pack(np.where(inside, padded[at[:, None] + np.arange(wide)], 0).astype(np.uint64), self.bits)
        #: By distinct window: its least and greatest key, its words; the items that have it are ``owners[bounds[p] : bounds[p + 1]]``.
        self.low, first, which = np.unique(low, axis=0, return_index=True, return_inverse=True)
        which, self.lengths = which.reshape(-1), length[first]
        beyond = np.where(np.arange(wide) < self.lengths[:, None], 0, (1 << self.bits) - 1).astype(np.uint64)
        self.high = self.low | _pack(beyond, self.bits)
        pairs = np.unique(np.stack([which, item], axis=1), axis=0)
        self.owners, self.bounds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.low) + 1))
        self.min_match = int(self.lengths.min()) if len(self.lengths) else window

    def _sorted(self) -> np.ndarray:
        """Where all suffixes begin, in order: ranks by so many words are doubled until they differ."""
        n = len(self.words)
        rank, step = np.unique(self.words, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
        while n and step < n:
            after = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n]
            after[self.words == -1] = -1
            pair = rank * (n + 1) + after + 1
            fresh = np.unique(pair, return_inverse=True)[1].reshape(-1)
            if (fresh == rank).all():
                break
            rank, step = fresh, 2 * step
        order = np.argsort(rank, kind="stable")
        return order[self.words[order] != -1]

    def shared(self, ids: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many words from ``places`` on of a shard are those from ``at`` on of the test set."""
        out, live, chunk = np.zeros(len(places), dtype=np.int64), np.arange(len(places)), 16
        left, right = np.append(ids, np.zeros(1, dtype=ids.dtype)), np.append(self.words, -1)
        while len(live):
            more = out[live, None] + np.arange(chunk)
            a = left[np.minimum(places[live, None] + more, len(ids))]
            b = right[np.minimum(at[live, None] + more, len(self.words))]
            same = np.cumprod(a == b, axis=1)
            out[live] += same.sum(axis=1)
            live = live[same[:, -1] == 1]
        return out

    def longest(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, rank) of the longest match of the test set with the shard's words from each place on."""
        lo, hi = np.zeros(len(places), dtype=np.int64), np.full(len(places), len(self.suffixes), dtype=np.int64)
        left, right = np.append(ids, 0), np.append(self.words, -1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            at = self.suffixes[mid]
            n = self.shared(ids, places[open_], at)
            less = right[np.minimum(at + n, len(self.words))] < left[np.minimum(places[open_] + n, len(ids))]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        best, rank = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for near in (lo - 1, lo):
            ok = np.flatnonzero((near >= 0) & (near < len(self.suffixes)))
            n = self.shared(ids, places[ok], self.suffixes[near[ok]])
            more = n > best[ok]
            best[ok[more]], rank[ok[more]] = n[more], near[ok[more]]
        return best, rank

    def where(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, place in the item) of suffixes."""
        at = self.suffixes[rank]
        item = np.searchsorted(self.begins, at, side="right") - 1
        return item, at - self.begins[item]


def key_words(window: int, bits: int) -> int:
    """The words of a key: whole 64-bit numbers."""
    return -(-window * bits // 64) * 64 // bits


def _pack(wide: np.ndarray, bits: int) -> np.ndarray:
    w = wide.reshape(len(wide), wide.shape[1] * bits // 64, 64 // bits)
    out = np.zeros(w.shape[:2], dtype=np.uint64)
    for k in range(w.shape[2]):
        out = out << np.uint64(bits) | w[:, :, k]
    return out


class SuffixArray:
    """The suffixes of ``ids`` that begin with at least ``min_match`` ids over 0, sorted by their first words."""

    def __init__(self, ids: np.ndarray, min_match: int, words: int, bits: int):
        n = len(ids)
        self.ids, self.wide = ids, key_words(words, bits)
        zero = np.flatnonzero(np.concatenate([ids, [0]]) == 0)
        run = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
        at = np.flatnonzero(run >= max(1, min_match))
        padded = np.concatenate([ids, np.zeros(self.wide, dtype=ids.dtype)])
        keys = _pack(padded[at[:, None] + np.arange(self.wide)].astype(np.uint64), bits)
        order = np.lexsort(keys.T[::-1])
        self.at, self.keys = at[order], keys[order]

    def search(self, queries: np.ndarray, after: bool) -> np.ndarray:
        """Where each query would stand: before the suffixes equal to it, or after them."""
        lo, hi = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(self.at), dtype=np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            keys = self.keys[np.minimum(mid, len(self.at) - 1)] if len(self.at) else queries
            less, same = np.zeros(len(queries), dtype=bool), np.ones(len(queries), dtype=bool)
            for k in range(queries.shape[1]):
                less |= same & (keys[:, k] < queries[:, k])
                same &= keys[:, k] == queries[:, k]
            right = open_ & (less | (same & after))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def intervals(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that begin with each window."""
        return self.search(test.low, False), self.search(test.high, True)


def _shards(texts: list, chars: int = 6_000_000) -> Iterator[tuple[int, int]]:
    from vellum.llm.tokens import batches_of

    return batches_of(texts, chars)


def _ids(texts: list, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word ids with a 0 after each document, where each document starts, its words)."""
    parts, counts, get = [], [], vocabulary.get
    for text in texts:
        w = words_of(text)
        counts.append(len(w))
        parts.append(np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w)))
        parts.append(np.zeros(1, dtype=np.int64))
    counts = np.array(counts, dtype=np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), np.cumsum(counts + 1) - counts - 1, counts


def scan_shard(texts: list, test: TestSet, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set], list[tuple | None]]:
    """(words, starts, hit by word, item ids by document, longest match by document) of a shard.

    A longest match is (words, item id, place in the item, place in the document), the first of equal ones; None without a hit.
    """
    ids, starts, counts = _ids(texts, test.vocabulary)
    items: list[set] = [set() for _ in texts]
    best: list[tuple | None] = [None] * len(texts)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    if len(test.low) and len(ids):
        array = SuffixArray(ids, test.min_match, window, test.bits)
        lo, hi = array.intervals(test)
        found = []
        for p in np.flatnonzero(hi > lo):
            places = array.at[lo[p] : hi[p]]
            found.append(places)
            np.add.at(cover, places, 1)
            np.add.at(cover, places + test.lengths[p], -1)
            owners = [test.items[i] for i in test.owners[test.bounds[p] : test.bounds[p + 1]]]
            for d in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
                items[d].update(owners)
        if found:
            places = np.unique(np.concatenate(found))
            words, rank = test.longest(ids, places)
            doc = np.searchsorted(starts, places, side="right") - 1
            order = np.lexsort((places, -words, doc))
            first = order[np.unique(doc[order], return_index=True)[1]]
            item, start = test.where(rank[first])
            for d, n, i, a, x in zip(doc[first].tolist(), words[first].tolist(), item.tolist(), start.tolist(), places[first].tolist(), strict=True):
                best[d] = (n, str(test.items[i]), a, x - int(starts[d]))
    return counts, starts, np.cumsum(cover[:-1]) > 0, items, best


def test_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", max_bytes: int = 4_000_000):
    """The test set in blocks of about ``max_bytes`` of text; one block at least."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // max_bytes))
    for k in range(n):
        yield k, n, TestSet([tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], window)


test_blocks.__test__ = False


_BEST = "struct<words:bigint,item:string,start:bigint,place:bigint>"


def _scan(test, window: int):
    best_type = pa.struct([("words", pa.int64()), ("item", pa.string()), ("start", pa.int64()), ("place", pa.int64())])

    def longer(a: dict | None, b: tuple | None) -> dict | None:
        return a if b is None or (a and a["words"] >= b[0]) else dict(zip(("words", "item", "start", "place"), b, strict=True))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = test.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo, hi in _shards(texts):
                part = batch.slice(lo, hi - lo)
                counts, starts, hit, items, best = scan_shard(texts[lo:hi], block, window)
                bits, n_hit = [], []
                for s, n, old in zip(starts.tolist(), counts.tolist(), part.column("_hit").to_pylist(), strict=True):
                    own = np.packbits(hit[s : s + n])
                    own = own | np.frombuffer(old, dtype=np.uint8) if old else own
                    n_hit.append(int(np.bitwise_count(own).sum()))
                    bits.append(own.tobytes())
                names = [sorted({*map(str, new), *(old or ())}) for new, old in zip(items, part.column("_items").to_pylist(), strict=True)]
                most = [longer(a, b) for a, b in zip(part.column("_best").to_pylist(), best, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_text"),
                        pa.array(counts),
                        pa.array(n_hit, pa.int64()),
                        pa.array(bits, pa.binary()),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array(most, best_type),
                    ],
                    names=["_id", "_text", "_n", "_n_hit", "_hit", "_items", "_best"],
                )

    return step


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 4_000_000
) -> DataFrame:
    """For each row of ``docs``: id, n_words, n_hit, items (ids as sorted strings), and longest: the longest verbatim match of a test
    suffix, as (words, item, start in the item, place in the document), null without a hit."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _text string, _n long, _n_hit long, _hit binary, _items array<string>, _best {_BEST}"
    nothing = ("0L AS _n", "0L AS _n_hit", "CAST(NULL AS binary) AS _hit", "CAST(NULL AS array<string>) AS _items", f"CAST(NULL AS {_BEST}) AS _best")
    rows = docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text", *nothing)
    for k, n, block in test_blocks(benchmark, window, max_bytes=max_bytes):
        rows = rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), window), schema)
        if k < n - 1:
            rows = scratch.write(rows, "block")
    names = {"_id": id_col, "_n": "n_words", "_n_hit": "n_hit", "_items": "items", "_best": "longest"}
    return rows.select(*[F.col(a).alias(b) for a, b in names.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", max_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that hold a window of the test set; columns as they are, no shuffle."""
    scratch = Scratch(docs.sparkSession, "decontaminate")

    def keep(test):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = test.value
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                for lo, hi in _shards(texts):
                    items = scan_shard(texts[lo:hi], block, window)[3]
                    yield batch.slice(lo, hi - lo).filter(pa.array([not x for x in items], pa.bool_()))

        return step

    rows = docs
    for k, n, block in test_blocks(benchmark, window, max_bytes=max_bytes):
        rows = rows.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
        if k < n - 1:
            rows = scratch.write(rows, "block")
    return rows


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The longest verbatim match of every test suffix and where it lies: item_id, start, words, doc id, place.

    Only matches of ``min_match`` words or more count. Of equally long ones the least (doc id, place) is given.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"item_id string, start long, words long, `{id_col}` {kind}, place long"
    out = None
    for _, _, block in test_blocks(benchmark, min_match):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = shared.value
            ranks = np.arange(len(test.suffixes))
            near = test.shared(test.words, test.suffixes[:-1], test.suffixes[1:])
            item, start = test.where(ranks)
            for batch in batches:
                texts, names = batch.column(1).to_pylist(), batch.column(0)
                for lo, hi in _shards(texts):
                    ids, starts, _ = _ids(texts[lo:hi], test.vocabulary)
                    places = SuffixArray(ids, min_match, 1, test.bits).at
                    words, rank = test.longest(ids, places)
                    doc = np.searchsorted(starts, places, side="right") - 1
                    by_name = pa.compute.rank(names.slice(lo, hi - lo), tiebreaker="dense", null_placement="at_start").to_numpy()
                    order = np.lexsort((places - starts[doc], by_name[doc], -words, rank))
                    best = matches_by_rank(len(ranks), near, words[order], rank[order], np.argsort(np.lexsort((places - starts[doc], by_name[doc])))[order], places[order])
                    ok = np.flatnonzero(best[0] >= min_match)
                    d = np.searchsorted(starts, best[1][ok], side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([str(test.items[i]) for i in item[ok]], pa.string()),
                            pa.array(start[ok]),
                            pa.array(best[0][ok]),
                            names.take(pa.array(d + lo)),
                            pa.array(best[1][ok] - starts[d]),
                        ],
                        names=["item_id", "start", "words", id_col, "place"],
                    )

        found = docs.select(id_col, text_col).mapInArrow(step, schema)
        out = found if out is None else out.union(found)
    best = out.groupBy("item_id", "start").agg(F.min(F.struct((-F.col("words")).alias("w"), id_col, "place")).alias("b"))
    return best.select("item_id", "start", (-F.col("b.w")).alias("words"), f"b.{id_col}", "b.place")


def matches_by_rank(n: int, near: np.ndarray, words: np.ndarray, rank: np.ndarray, order: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, place) of the longest match of each of ``n`` sorted test suffixes; the least ``order`` of equal ones.

    ``words``, ``rank``: of each place, its longest match and the suffix that has it. Another suffix matches there as far as the two are
    alike, which ``near`` says for neighbours: so matches are passed on along the order, both ways.
    """
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * n
    for w, r, o, p in zip(words.tolist(), rank.tolist(), order.tolist(), places.tolist(), strict=True):
        best[r] = min(best[r], (-w, o, p))
    alike = near.tolist()
    for steps in (range(1, n), range(n - 2, -1, -1)):
        for r in steps:
            old = best[r - 1] if steps.step > 0 else best[r + 1]
            most = min(-old[0], alike[r - 1] if steps.step > 0 else alike[r])
            if most:
                best[r] = min(best[r], (-most, old[1], old[2]))
    return np.array([-w for w, _, _ in best], dtype=np.int64), np.array([p for _, _, p in best], dtype=np.int64)


def digest_items(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)


