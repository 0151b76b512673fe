"""Token ids in binary files, coded with a static range asymmetric numeral system (operator 8).

All blocks share one frequency table, counted over the whole corpus while it is tokenised, and scaled to 2^20. A block is up to BLOCK ids, dealt
in turn to LANES interleaved states of 64 bits, which put out 32-bit words into one stream; it needs nothing from
other blocks. A file is: magic; blocks (the states where decoding begins, then the words); the index; its length
and magic. The index holds, per block, a checkpoint (first id, ids, byte offset and length, CRC-32 of the bytes and of the
ids), and per document its id and number of ids. So blocks can be decoded in parallel, from any place, and
every byte is checked. Files are in ascending order of document id, nulls first; ties go by length and checksum. A task
goes on to another file after FILE_IDS ids, between documents, so that a file's index stays small and a file is a unit of reading.

Encoding and decoding run over many blocks at once: a numpy step moves every lane of every block by one id.

Edge cases. Null and empty texts hold the end id only. Repeated rows are all written. An empty table gives no
files. Extra columns are left out. Ids are whole numbers (cast to long; other types are refused). A very long text is one
document of one file, which is then longer than others; it is coded block by block like any other.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, partitions
from vellum.llm.files import Ranges, open_folder, write_whole
from vellum.llm.tokens import batches_of, encoder

MAGIC = b"VLMRANS1"
BITS = 20
LANES = 64
BLOCK = 1 << 14
#: Blocks that are coded at a time, and ids after which a task begins another file.
GROUP, FILE_IDS = 128, 1 << 23
_LOW = np.uint64(1 << 31)


def scale(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, at least 1 for each id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    out = np.where(counts > 0, np.maximum(1, counts * (1 << BITS) // total), 0).astype(np.int64)
    excess = int(out.sum()) - (1 << BITS)
    order = np.argsort(-out, kind="stable")
    if excess < 0:
        out[order[0]] -= excess
    at = 0
    while excess > 0:  # take from the most frequent ones in turn
        i = order[at % len(order)]
        take = min(excess, max(0, int(out[i]) - 1), max(1, int(out[i]) // 8))
        out[i] -= take
        excess -= take
        at += 1
    return out.astype(np.uint64)


class Table:
    """The shared table: frequency, first slot, and of each slot its id and its place among those of the id."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.rest = (np.arange(len(self.slots), dtype=np.uint64) - self.start[self.slots]).astype(np.uint32)


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Each block's states and words."""
    steps = -(-max(map(len, blocks)) // LANES)
    ids = np.zeros((len(blocks), steps * LANES), dtype=np.int32)
    real = np.zeros(ids.shape, dtype=bool)
    for b, block in enumerate(blocks):
        ids[b, : len(block)] = block
        real[b, : len(block)] = True
    ids, real = ids.reshape(len(blocks), steps, LANES), real.reshape(len(blocks), steps, LANES)
    state = np.full((len(blocks), LANES), _LOW)
    words = np.zeros((steps, len(blocks), LANES), dtype=np.uint32)
    given = np.zeros(words.shape, dtype=bool)
    whole = min(map(len, blocks)) // LANES  # so many steps have an id for each lane
    for t in range(steps - 1, -1, -1):
        f, s = table.freq[ids[:, t]], table.start[ids[:, t]]
        if t < whole:
            out = state >= f << np.uint64(63 - BITS)
            words[t], given[t] = state, out
            x = np.where(out, state >> np.uint64(32), state)
            q = x // f
            state = x + q * (np.uint64(1 << BITS) - f) + s
            continue
        live = real[:, t]
        out = live & (state >= f << np.uint64(63 - BITS))
        words[t], given[t] = state.astype(np.uint32), out
        x = np.where(out, state >> np.uint64(32), state)
        f = np.where(live, f, np.uint64(1))
        q = x // f
        state = np.where(live, (q << np.uint64(BITS)) + (x - q * f) + s, state)
    return [state[b].astype("<u8").tobytes() + words[:, b][given[:, b]].astype("<u4").tobytes() for b in range(len(blocks))]


def decode_blocks(payloads: list[bytes], counts: list[int], table: Table) -> list[np.ndarray]:
    steps = -(-max(counts) // LANES)
    head = 8 * LANES
    state = np.stack([np.frombuffer(p, dtype="<u8", count=LANES) for p in payloads]).astype(np.uint64)
    streams = [np.frombuffer(p, dtype="<u4", offset=head) for p in payloads]
    stream = np.concatenate([*streams, np.zeros(1, dtype="<u4")]).astype(np.uint64)
    at = np.cumsum([0, *map(len, streams)])[:-1]
    left, whole = np.array(counts), min(counts) // LANES  # so many steps have an id for each lane
    out = np.zeros((steps, len(payloads), LANES), dtype=np.uint32)
    lanes = np.arange(LANES)
    mask = np.uint64((1 << BITS) - 1)
    rest = table.rest
    for t in range(whole):
        slot = (state & mask).astype(np.int64)
        ids = out[t] = table.slots[slot]
        state = table.freq[ids] * (state >> np.uint64(BITS)) + rest[slot]
        low = state < _LOW
        taken = low.sum(axis=1)
        place = np.arange(taken.sum()) + np.repeat(at - (np.cumsum(taken) - taken), taken)
        state[low] = state[low] << np.uint64(32) | stream[place]
        at = at + taken
    for t in range(whole, steps):
        live = t * LANES + lanes[None, :] < left[:, None]
        slot = state & mask
        ids = table.slots[slot.astype(np.int64)]
        x = table.freq[ids] * (state >> np.uint64(BITS)) + slot - table.start[ids]
        low = live & (x < _LOW)
        place = at[:, None] + np.cumsum(low, axis=1) - 1
        x = np.where(low, x << np.uint64(32) | stream[np.where(low, place, 0)], x)
        at = at + low.sum(axis=1)
        state = np.where(live, x, state)
        out[t] = ids
    return [out[:, b].reshape(-1)[:n] for b, n in enumerate(counts)]


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, crc, ids, counts): all ids of each row's text and the end id; 16 bits an id if they are enough.

    ``counts`` is null but in a last row of each task, which has nothing else: how often the task has met each id.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold whole numbers")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, spaced=True)
        size = vocabulary_size(tokenizer.tokenizer, end_id)
        kind, total = id_type(size), np.zeros(size, dtype="<i8")
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                ids = [np.concatenate([x, end]) for x in tokenizer.encode_batch(texts[lo:hi])]
                short = np.concatenate(ids).astype(kind)
                total += np.bincount(short, minlength=size)
                raw, ends = short.tobytes(), np.cumsum([len(x) for x in ids]) * short.itemsize
                yield _token_rows(
                    batch.column(0).slice(lo, hi - lo),
                    [len(x) for x in ids],
                    [zlib.crc32(x) for x in ids],
                    [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)],
                    [None] * len(ids),
                )
        if total.any():
            yield _token_rows(pa.array([None], pa.int64()), [0], [0], [None], [total.tobytes()])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(step, "id long, n long, crc long, ids binary, counts binary")


def _token_rows(ids: pa.Array, n: list, crc: list, raw: list, counts: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = [ids, *(pa.array(x, k) for x, k in zip((n, crc, raw, counts), kinds, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n", "crc", "ids", "counts"])


def vocabulary_size(tokenizer, end_id: int) -> int:
    return max(tokenizer.get_vocab_size(), end_id + 1)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the whole corpus, from the tasks' own counts: sums of at most ``vocabulary`` rows reach the driver."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(vocabulary, dtype=np.int64)
    for i, n in tokens.where("counts IS NOT NULL").select("counts").mapInArrow(step, "i long, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write_archive(
    docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS
) -> None:
    """Encodes ``docs`` into ``folder``: table.bin, part-*.rans, and the manifest (a Parquet table)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    tokens = scratch.write(tokenize(docs, path, end_id, id_col, text_col), "ids", compression="zstd")
    vocabulary = vocabulary_size(Tokenizer.from_file(path), end_id)
    frequencies = scale(count_ids(tokens, vocabulary))
    with write_whole(folder, "table.bin") as out:
        out.write(frequencies.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(frequencies)
    kind = id_type(vocabulary)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table, rows = TaskContext.get().partitionId(), Table(shared.value), _documents(batches, kind)
        doc, file = next(rows, None), 0
        while doc is not None:
            name = f"part-{part:06d}-{file:06d}.rans"
            with write_whole(folder, name) as out:
                writer = _Writer(out, table)
                while doc is not None and writer.given < file_ids:
                    writer.add(*doc)
                    doc = next(rows, None)
                writer.close()
            columns = [pa.array([x], k) for x, k in ((part, pa.int32()), (file, pa.int32()), (name, pa.string()), (writer.ids, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "no", "file", "n_ids"])
            file += 1

    order = [F.col("id").asc_nulls_first(), F.col("n"), F.col("crc")]
    ranged = tokens.where("counts IS NULL").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    files = ranged.select("id", "ids").mapInArrow(step, _MANIFEST)
    files.write.parquet(f"{folder}/manifest")
    scratch.drop(tokens)


_MANIFEST = "part int, no int, file string, n_ids long"


def _documents(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        for doc, ids in zip(batch.column(0), batch.column(1), strict=True):
            yield doc.as_py(), np.frombuffer(ids.as_py(), dtype=kind)


class _Writer:
    def __init__(self, out, table: Table):
        self.out, self.table = out, table
        self.at, self.ids, self.held, self.size, self.given = len(MAGIC), 0, [], 0, 0
        self.blocks: list[tuple] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        self.given += len(ids)
        if self.size >= GROUP * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint16)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        blocks = [ids[i : min(i + BLOCK, end)] for i in range(0, end, BLOCK)]
        for g in range(0, len(blocks), GROUP):
            group = blocks[g : g + GROUP]
            for block, data in zip(group, encode_blocks(group, self.table), strict=True):
                self.blocks.append((self.ids, len(block), self.at, len(data), zlib.crc32(data), zlib.crc32(block.astype("<u4").tobytes())))
                self.out.write(data)
                self.at += len(data)
                self.ids += len(block)
        self.held, self.size = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        null = [d is None for d in self.docs]
        arrays = [np.array(self.blocks, dtype="<i8").reshape(-1, 6), np.array([d or 0 for d in self.docs], dtype="<i8"), np.array(null, dtype="u1"), np.array(self.counts, dtype="<i8")]
        index = zlib.compress(b"".join(a.tobytes() for a in arrays))
        head = json.dumps({"blocks": len(self.blocks), "docs": len(self.docs), "crc": zlib.crc32(index), "bytes": len(index)}).encode()
        self.out.write(index + head + struct.pack("<I", len(head)) + MAGIC)


def read_index(files: Ranges, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, document ids, which of them are null, ids of each document)."""
    size = files.size(name)
    tail = files.read(name, size - 12, 12)
    n = struct.unpack("<I", tail[:4])[0]
    head = json.loads(files.read(name, size - 12 - n, n))
    data = files.read(name, size - 12 - n - head["bytes"], head["bytes"])
    if tail[4:] != MAGIC or zlib.crc32(data) != head["crc"]:
        raise ValueError(f"{name}: the index is damaged")
    data, b, d = zlib.decompress(data), head["blocks"], head["docs"]
    blocks = np.frombuffer(data, dtype="<i8", count=6 * b).reshape(-1, 6)
    docs = np.frombuffer(data, dtype="<i8", count=d, offset=48 * b)
    null = np.frombuffer(data, dtype="u1", count=d, offset=48 * b + 8 * d)
    return blocks, docs, null, np.frombuffer(data, dtype="<i8", count=d, offset=48 * b + 9 * d)


def read_ids(files: Ranges, name: str, blocks: np.ndarray, start: int, count: int, table: Table) -> np.ndarray:
    """``count`` ids of a file from ``start`` on: only the blocks that hold them are read, and all of them are checked."""
    if not count:
        return np.zeros(0, dtype=np.uint32)
    first = int(np.searchsorted(blocks[:, 0], start, side="right")) - 1
    last = int(np.searchsorted(blocks[:, 0], start + count, side="left"))
    out = []
    for g in range(first, last, GROUP):
        part = blocks[g : min(g + GROUP, last)].tolist()
        payloads = [files.read(name, b[2], b[3]) for b in part]
        if any(zlib.crc32(p) != b[4] for p, b in zip(payloads, part, strict=True)):
            raise ValueError(f"{name}: a block is damaged")
        for ids, b in zip(decode_blocks(payloads, [b[1] for b in part], table), part, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != b[5]:
                raise ValueError(f"{name}: a block was decoded wrongly")
            out.append(ids)
    from_ = start - int(blocks[first, 0])
    return np.concatenate(out)[from_ : from_ + count]


def read_archive(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, (ids)) of each document, decoded from the files in parallel, each by the blocks of its index."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").where("n_ids > 0")
    # The parts are as many as the archive had tasks; within a part the files are numbered.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    units = files.withColumn("within", within).join(parts, "part").select("file", (F.col("part_start") + F.col("within")).alias("before"))
    system, path = open_folder(folder)
    with system.open_input_stream(f"{path}/table.bin") as raw:
        shared = spark.sparkContext.broadcast(np.frombuffer(raw.read(), dtype="<u4"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranges = Table(shared.value), Ranges(folder)
        for batch in batches:
            for unit in batch.to_pylist():
                yield from _read_file(ranges, unit["file"], unit["before"], table, keep_ids)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return units.repartition(4 * partitions(spark)).mapInArrow(step, schema)


def _read_file(ranges: Ranges, file: str, before: int, table: Table, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a file, a group of blocks at a time: those that begin there; the last one may reach further."""
    blocks, docs, null, counts = read_index(ranges, file)
    starts = np.cumsum(counts) - counts
    for g in range(0, len(blocks), GROUP):
        till = min(g + GROUP, len(blocks))
        lo, hi = np.searchsorted(starts, [blocks[g, 0], blocks[till - 1, 0] + blocks[till - 1, 1]])
        if lo == hi:
            continue
        ids = read_ids(ranges, file, blocks, int(starts[lo]), int(counts[lo:hi].sum()), table).astype("<u4")
        cuts = (starts[lo:hi] - starts[lo]).tolist()
        parts = [ids[a : a + n].tobytes() for a, n in zip(cuts, counts[lo:hi].tolist(), strict=True)]
        columns = [
            pa.array(docs[lo:hi], mask=null[lo:hi].astype(bool)),
            pa.array(starts[lo:hi] + before),
            pa.array(counts[lo:hi]),
            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
        ]
        if keep_ids:
            columns.append(pa.array(parts, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
