"""Substring dedup with a log-structured fingerprint index (operator 4).

A window is so many consecutive words of one document. Each word is removed that lies in a window whose word sequence
also starts anywhere else, the same document included.

Fingerprints. Of the hashes of every 8 words, the least one in each run of (window - 7) is selected (the rightmost of equal
ones), so each window holds a selected hash and equal windows hold the same one at the same place: about one word in
14 is selected, and no repeat can hide.

Index. ``FingerprintIndex`` is a folder: a log of immutable runs, each a Parquet table of (fingerprint, key), bucketed and
sorted by fingerprint, with a key of the document's text, and a manifest of versions that any later session opens. A new batch is written as a run and merge-joined with
the runs of history, of which nothing is dealt out again: both sides lie in the same buckets. What the batch shares with
history, or has twice itself, are its hits; the runs say in which documents a hit lies. When a tier has ``fanout`` runs they
are compacted into one run of the next tier. ``find_repeats`` goes this way, batch by batch; given an index of earlier
batches and their documents, it judges the new batch against both.

Verification. The documents that hold hits are read. In those only, each window around a hit gets a 96-bit hash of its words,
and a window whose hash occurs more than once is a repeat. Equal texts take part once, with the weight of two.

Shuffles. Fingerprints go once by fingerprint, the text once by document key, and is read three times from that shuffle. Windows are
dealt out by their hash alone, so that the adaptive planner can split a hot one; counts are summed up before the shuffle.

Edge cases. Null texts have no words. Rows with equal text are copies of each other, rows that are equal in every column
too. An empty table gives an empty result. A very long text is worked on by itself, in arrays of its words. Keys are
64-bit hashes, of the text in the index, of id and text elsewhere. Windows must have eight words at least. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, partitions, redealt

GRAM = 8
_BASE = 0x9E3779B97F4A7C15
_CHECK = 0xD6E8FEB86659FD93


def _word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _rolled(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive words: a polynomial in ``base`` modulo 2^64, mixed at the end."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    # Doubling: width holds the polynomial of 1, 2, 4, ... words; those that make up n are put together.
    power, width, done, factor = words, 1, 0, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            if n & width:
                out = out * factor + power[done : done + count]
                done += width
            if done < n:
                power = power[: len(power) - width] * factor + power[width:]
                factor, width = factor * factor, 2 * width
        out ^= out >> np.uint64(32)
        out = out * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return out


def selected(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of a document, from its word hashes."""
    grams = _rolled(words, GRAM, _BASE)
    span = window - GRAM + 1
    if len(grams) < span:
        return np.zeros(0, dtype=np.int64), grams[:0]
    # The place of the least of each span, the rightmost of equal ones, by doubling.
    def least(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(grams[right] <= grams[left], right, left)

    best, width = np.arange(len(grams)), 1
    while 2 * width <= span:
        best, width = least(best[:-width], best[width:]), 2 * width
    count = len(grams) - span + 1
    places = np.unique(least(best[:count], best[span - width : span - width + count]))
    return places, grams[places]


def _table(run: str) -> str:
    return f"vellum_{run.replace('-', '_')}"


class FingerprintIndex:
    """A log of sorted runs (fp, key) in ``folder``; opened again if a manifest lies there."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.version, self.buckets, self.runs = 0, buckets or partitions(spark), []
        versions = self._files().globStatus(self._path("manifest-*.json")) or []
        if len(versions):
            last = max(v.getPath().toString() for v in versions)
            found = json.loads(spark.read.text(last, wholetext=True).first()[0])
            self.version, self.buckets, self.runs = found["version"], found["buckets"], found["runs"]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, runs: list[dict]) -> None:
        """The next version of the manifest comes into being by a rename; runs that it no longer names are deleted then."""
        files, own = self._files(), self._path(f".manifest-{uuid.uuid4().hex}")
        out = files.create(own)
        out.write(bytearray(json.dumps({"version": self.version + 1, "buckets": self.buckets, "runs": runs}).encode()))
        out.close()
        if not files.rename(own, self._path(f"manifest-{self.version + 1:012d}.json")):
            raise RuntimeError(f"{self.folder}: another writer was faster")
        kept = {r["name"] for r in runs}
        for gone in (r["name"] for r in self.runs if r["name"] not in kept):
            self.spark.sql(f"DROP TABLE IF EXISTS {_table(gone)}")
            files.delete(self._path(gone), True)
        self.version, self.runs = self.version + 1, runs

    def _open(self, name: str) -> DataFrame:
        """A run as a table that is known to be bucketed, so that joins and counts by fp need no shuffle of it."""
        table = _table(name)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (fp BIGINT, key BIGINT) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return self.spark.table(table)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex[:16]}"
        dealt = rows.select("fp", "key").repartition(self.buckets, "fp")
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(_table(name))
        return name

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Adds a batch (fp, key) as a run; returns its hits: the distinct fps that it has twice or that history has."""
        name = self._write(fingerprints)
        own = self._open(name)
        hits = own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
        for run in self.runs:
            hits = hits.union(own.join(self._open(run["name"]).hint("merge"), "fp", "left_semi").select("fp"))
        # The join's rows are those of the batch; they are one a fingerprint before anything moves.
        hits = self.spark.read.schema("fp long").parquet(self._kept(hits.distinct()))
        self._commit([*self.runs, {"name": name, "tier": 0}])
        self._settle()
        return hits

    def _kept(self, hits: DataFrame) -> str:
        path = f"{self.folder}/hits-{uuid.uuid4().hex[:16]}"
        hits.write.parquet(path)
        return path

    def _settle(self) -> None:
        """Merges a tier that is full into one run of the next tier, as long as there is one."""
        while True:
            tiers = Counter(r["tier"] for r in self.runs)
            full = [t for t, n in tiers.items() if n >= self.fanout]
            if not full:
                return
            self._merge([r for r in self.runs if r["tier"] == min(full)], min(full) + 1)

    def _merge(self, some: list[dict], tier: int) -> None:
        rows = functools.reduce(DataFrame.union, [self._open(r["name"]) for r in some])
        name = self._write(rows)
        self._commit([r for r in self.runs if r not in some] + [{"name": name, "tier": tier}])

    def compact(self) -> None:
        """One run of everything."""
        if len(self.runs) > 1:
            self._merge(list(self.runs), max(r["tier"] for r in self.runs) + 1)

    def locations(self, hits: DataFrame) -> DataFrame:
        """(fp, key): where the hits (distinct fps) lie, in all runs: a merge join with each."""
        found = [self._open(r["name"]).join(hits.hint("merge"), "fp", "left_semi") for r in self.runs]
        return functools.reduce(DataFrame.union, found) if found else hits.selectExpr("fp", "fp AS key").limit(0)


def fingerprints(docs: DataFrame, window: int, key: str, text_col: str) -> DataFrame:
    """(fp, key): a row for each selected fingerprint of each text, ``key`` being a hash of the text.

    All that matters of a fingerprint is where it lies and whether it occurs again: so one that a text has more than twice is two
    rows, and a text that a task meets more than twice is worked on twice. Hot copies and texts of one phrase stay small this way.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 1000):
                fps, counts = [], []
                for own, text in zip(keys[lo : lo + 1000].tolist(), batch.column(1)[lo : lo + 1000], strict=True):
                    data = (text.as_py() or "").encode()
                    met[own, len(data)] += 1
                    words = data.split() if met[own, len(data)] <= 2 else []
                    found = np.zeros(0, dtype=np.uint64)
                    if len(words) >= window:
                        found, times = np.unique(selected(_word_hashes(words, 0), window)[1], return_counts=True)
                        found = np.repeat(found, np.minimum(times, 2))
                    fps.append(found)
                    counts.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.repeat(keys[lo : lo + 1000], counts))], names=["fp", "key"]
                )

    return docs.select(key, text_col).mapInArrow(step, "fp long, key long")


def _candidate_windows(window: int):
    """(id, key, text, found: fingerprints that repeat, w: weight) -> (h, c, key, at, w): the windows that hold one of them."""

    names = ["h", "c", "key", "at", "w"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [[], [], [], [], []], 0
            for key, text, found, weight in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                words = text.as_py().encode().split()
                hashes = _word_hashes(words, 0)
                places, fps = selected(hashes, window)
                places = places[np.isin(fps, np.asarray(found.values.to_numpy(zero_copy_only=False)).view(np.uint64))]
                count = len(words) - window + 1
                cover = np.zeros(count + 1, dtype=np.int64)
                np.add.at(cover, np.maximum(places - (window - GRAM), 0), 1)
                np.add.at(cover, np.minimum(places + 1, count), -1)
                at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                out[0].append(_rolled(hashes, window, _BASE)[at].view(np.int64))
                out[1].append((_rolled(_word_hashes(words, 1), window, _CHECK)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out[2].append(np.full(len(at), key.as_py()))
                out[3].append(at.astype(np.int32))
                out[4].append(np.full(len(at), weight.as_py(), dtype=np.int32))
                size += len(at)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                    out, size = [[], [], [], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return step


def _removed(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    cover = np.zeros(words + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return np.cumsum(cover[:-1]) > 0


def find_repeats(
    docs: DataFrame,
    window: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    index: FingerprintIndex | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """For each row of ``docs``: id, n_words, n_removed, kept_text (kept words joined by one space).

    ``index``: of earlier batches, to which ``docs`` is added; ``history`` are their documents, of which those with hits are read.
    An index that holds runs needs its history, since hits are verified on texts: without it this raises, before anything is written.
    """
    if window < GRAM:
        raise ValueError(f"a window must have {GRAM} words at least")
    if index is not None and index.runs and history is None:
        raise ValueError("the index holds earlier batches: their documents are needed as history")
    scratch = Scratch(docs.sparkSession, "substrings")
    index = index or FingerprintIndex(docs.sparkSession, scratch.path("index"))

    def keyed(of: DataFrame, new: bool) -> DataFrame:
        i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
        return of.select(i.alias("_id"), t.alias("_text"), F.xxhash64(i, t).alias("_key"), F.xxhash64(t).alias("_own"), F.lit(new).alias("_new"))

    rows = keyed(docs, True)
    hits = None
    for k in range(batches):
        found = index.add(fingerprints(rows.where(F.pmod("_own", F.lit(batches)) == k), window, "_own", "_text"))
        hits = found if hits is None else hits.union(found)
    if history is not None:
        rows = rows.union(keyed(history, False))
    # Copies: of equal texts one row (the least key) takes part, for two.
    texts = rows.where("_text IS NOT NULL").select("_key", F.xxhash64("_text").alias("_t"), F.md5("_text").alias("_d"))
    equal = texts.groupBy("_t", "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_first")).where("_n > 1")
    equal = scratch.write(equal.select("_t", F.col("_d").alias("_e"), "_first"), "equal")
    copies = texts.join(equal, ["_t"]).where("_d = _e").select("_key", "_first").distinct()
    per_text = index.locations(hits.distinct()).groupBy("key").agg(F.collect_set("fp").alias("_found"))
    mine = rows.where("_text IS NOT NULL").select(F.col("_key").alias("key"), "_own")
    per_row = mine.join(redealt(per_text, "key", "_t"), F.col("_own") == F.col("_t")).groupBy("key").agg(F.first("_found").alias("_found"))
    info = scratch.write(per_row.join(copies, per_row.key == copies._key, "full").select(F.coalesce("key", "_key").alias("_k"), "_found", "_first"), "info")

    text = rows.select("_key", "_text", "_id", "_new")
    told = text.join(info, F.col("_key") == F.col("_k"), "left")
    active = told.where("_found IS NOT NULL AND (_first IS NULL OR _first = _key)")
    # All columns of the text's shuffle are read, so that both joins share it.
    weight = F.when(F.col("_first").isNull(), 1).otherwise(2)
    windows = active.select("_id", "_key", "_text", "_found", weight.alias("_w")).mapInArrow(_candidate_windows(window), "h long, c int, key long, at int, w int")
    counts = windows.groupBy("h", "c").agg(F.sum("w").alias("n")).where("n > 1")
    again = redealt(counts.select("h", F.col("c").alias("_c")), "h", "_h")
    repeats = windows.where("w = 1").join(again, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")))
    starts = repeats.groupBy("key").agg(F.collect_set("at").alias("_starts"))
    last = told.join(starts, F.col("_key") == F.col("key"), "left").where("_new")
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n, gone, kept = [], [], []
            for value, copy, at in zip(*(batch.column(i) for i in range(1, 4)), strict=True):
                words = (value.as_py() or "").encode().split()
                n.append(len(words))
                if copy.as_py() and len(words) >= window:
                    gone.append(len(words))
                    kept.append("")
                elif not at.is_valid:
                    gone.append(0)
                    kept.append(b" ".join(words).decode())
                else:
                    away = _removed(len(words), at.values.to_numpy(zero_copy_only=False), window)
                    gone.append(int(away.sum()))
                    kept.append(b" ".join([w for w, x in zip(words, away.tolist(), strict=True) if not x]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    shaped = last.select("_id", "_text", F.col("_first").isNotNull().alias("_copy"), "_starts")
    return shaped.mapInArrow(finish, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")


