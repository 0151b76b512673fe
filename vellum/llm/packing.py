"""Best-fit decreasing packing of token sequences (operator 1).

Documents are cut into pieces of at most ``capacity`` tokens; then the pieces, longest first, each go where they fit
tightest: into the open sequence with the least remaining capacity that is enough, found by a segment tree over the
remaining capacities in logarithmic time; if none is open, a new sequence is opened.

Pieces of one length are interchangeable, so the decision needs only the number of pieces of each length: at most
``capacity`` numbers, whatever the size of the corpus. The driver packs this histogram, many pieces of
one length at a time, and the outcome is a plan of ranges: pieces a to b of length n go to sequences c to d at one offset.
Sequences of equal remaining capacity are kept as ranges, and a length splits one range at most, so the plan has at most
some capacity squared entries, and a few thousand in practice; its size is checked before it is sent out. On the executors, pieces are
numbered within their length, bucket by bucket, and look up their range by binary search.

Edge cases. Null and empty texts are the end token only. A very long text is many pieces, all but the last of them full. Repeated rows are packed each. An empty table gives an
empty result. Any other columns of ``documents`` are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, dense_rank_by_bucket
from vellum.llm.tokens import batches_of, encoder

#: Pieces of one length are numbered in buckets: so many at least, and of so many pieces each.
BUCKETS, BUCKET_ROWS = 256, 200_000
PLAN_LIMIT = 4_000_000


class CapacityTree:
    """A segment tree over capacities 0 to n: which of them has an open sequence, least first."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.has = [False] * (2 * self.size)

    def put(self, capacity: int, has: bool) -> None:
        at = self.size + capacity
        self.has[at] = has
        while at > 1:
            at //= 2
            self.has[at] = self.has[2 * at] or self.has[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that has an open sequence."""
        at = self.size + need
        if self.has[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.has[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first piece, pieces, first sequence, offset), best-fit decreasing."""
    tree, open_, out, sequences = CapacityTree(capacity), {}, [], 0

    def fill(first: int, n: int, pieces: int, room: int) -> None:
        """``n`` sequences of one remaining capacity take ``pieces`` pieces each."""
        nonlocal done
        for i in range(pieces):
            out.append((length, done, n, first, capacity - room + i * length))
            done += n
        if room := room - pieces * length:
            open_.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        done, all_ = 0, histogram[length]
        while done < all_:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                n = -(-(all_ - done) // (room // length))
                first, sequences = sequences, sequences + n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.put(room, False)
            # A sequence that has taken a piece is the tightest one for the next, as long as that fits.
            each = room // length
            full = min(n, (all_ - done) // each)
            if full:
                fill(first, full, each, room)
            if full < n:
                rest = all_ - done
                if rest:
                    fill(first + full, 1, rest, room)
                left = n - full - (rest > 0)
                if left:
                    open_.setdefault(room, []).append((first + full + (rest > 0), left))
                    tree.put(room, True)
    return out


def tokenize(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and ids (little-endian 32-bit) if ``keep_ids``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], dtype="<u4")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, spaced=False)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                which, piece, start, length, crc, raw = [], [], [], [], [], []
                for row, ids in enumerate(tokenizer.encode_batch(texts[lo:hi]), lo):
                    data = np.concatenate([ids, end]).tobytes()
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        which.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        raw.append(part if keep_ids else b"")
                columns = [batch.column(0).take(pa.array(which)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if keep_ids:
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(step, schema)


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``capacity``; a table that can be read again) with sequence_id and offset."""
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    entries = plan(histogram, capacity)
    if len(entries) > PLAN_LIMIT:
        raise RuntimeError(f"a plan of {len(entries)} entries is over the limit of {PLAN_LIMIT}")
    rows = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(rows)
    buckets = max(BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    numbered = dense_rank_by_bucket(pieces, ["length"], bucket, [F.col(c) for c in order], "_number")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            at = np.searchsorted(starts, length << 44 | number, side="right") - 1
            found = [table[at, 3] + number - table[at, 1], table[at, 4]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*names, "_number").mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """All documents, tokenised once and packed: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(tokenize(docs, path, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    return pack(pieces, capacity, (id_col, "piece", "ids_crc32"))
