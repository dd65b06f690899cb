"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.session import checkpoint_dir, scratch_path

#: Separators of words; a word is a maximal run of other bytes.
WORD = r"[^\x20\x09-\x0D]+"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors once per application, so that tasks can import it
    whatever folder the driver runs in."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    fd, path = tempfile.mkstemp(prefix="tabwatch-", suffix=".zip")  # read by this driver only
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tabwatch")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """What every operator needs before its first job: code on the executors, a shared folder,
    and Arrow batches bounded in bytes (long texts)."""
    ship_package(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Freed memory goes back to the system: workers are kept for later tasks, and what the allocators
    hold would stay with the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def gives_back(step: Callable) -> Callable:
    """``step`` (batches to batches in a worker), after which freed memory goes back."""
    @functools.wraps(step)
    def run(*args) -> Iterator[pa.RecordBatch]:
        yield from step(*args)
        give_back()

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, kept across lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(col: str) -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit("").cast("binary"))


def remainder(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only while the counted rows stay below ``most``; a plain join otherwise."""
    return F.broadcast(df) if rows <= most else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node id.

    Alternates large-star and small-star steps: every round is two grouped joins over the edges,
    written to the shared folder, until a round changes nothing. No edge list reaches the driver.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a points at the smallest node next to a
        large = (both.where("b > a").join(low, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: the smaller neighbours of a, and a itself, point at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = written(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc-edges")
        # a forest of stars: no target is itself a source, and every source has one target
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("target")).union(
            e.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("target")))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("target").alias("target"))
        if not ends.where("out > 1 or (out = 1 and target = 1)").take(1):
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
