"""Shared pieces: loading, scratch tables in the folder that the cluster shares, numbering and components.

Scratch tables cut lineage. They lie under ``spark.checkpoint.dir``, so that any executor can read what
another one wrote, and a lost executor costs only the tasks that it was running.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.session import shared_root

#: Characters that end a word for the operators that split on ASCII white space.
WORD_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """A folder of this run's own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """The same rows, read from a written table: lineage ends here."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def tidy(self) -> None:
        """Frees the shuffle files of what write() has cut off: Spark deletes them once the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of write() that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's content; rows that are equal in these columns share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def dense_rank_by_bucket(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 in its group, ordered by ``bucket``, a whole number, then ``order``.

    A group is numbered bucket by bucket, with offsets from the buckets' counts, so that no task sorts
    a whole group. The table of counts has a row for each group and bucket.
    """
    at, start, i, n = fresh(df, "_bucket", "_start", "_i", "_n")
    rows = df.withColumn(at, bucket.cast("long"))
    counts = rows.groupBy(*group, at).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(*group).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = rows.withColumn(i, F.row_number().over(W.partitionBy(*group, at).orderBy(*order)) - 1)
    return within.join(starts, [*group, at]).withColumn(name, (F.col(start) + F.col(i)).cast("long")).drop(at, start, i)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text with different beginnings: together the row's identity."""
    of = [F.col(f"`{c}`") for c in (id_col, text_col)]
    return F.xxhash64(*of), F.xxhash64(F.lit("row"), *of)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda function evaluates what it refers to for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def redealt(df: DataFrame, key: str, to: str) -> DataFrame:
    """``df`` with its long column ``key`` as ``to``, of which Spark doesn't know how it is partitioned.

    A join on ``to`` then deals out both sides anew, and only such joins can be split at a hot key.
    """
    return df.withColumn(to, F.bitwise_not(F.bitwise_not(key))).drop(key)


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, root), root the least node that it can reach.

    Roots are among the nodes; nodes without a link are not.

    Alternates the large-star and small-star steps. Each step is one aggregation by node and one join
    back to the edges, whose skewed keys the adaptive planner splits. Every round is written to the
    shared folder; links never reach the driver, only their count and a checksum of them do.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        n = both(e)
        least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = n.where("b > a").join(redealt(least, "a", "k"), F.col("a") == F.col("k"))
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        n = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = n.groupBy("a").agg(F.min("b").alias("m"))
        moved = n.join(redealt(least, "a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    now = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = mark(now)
    for _ in range(rounds):
        after = scratch.write(small(large(now)), "edges")
        scratch.drop(now)
        now, last = after, seen
        seen = mark(now)
        if seen == last:
            roots = now.select("b").distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
    raise RuntimeError(f"components: not stable after {rounds} rounds")


