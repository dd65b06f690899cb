"""Token files of directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every token of a
segment; a bitmap says which tokens continue, and level 1 holds the next chunk of those alone,
and so on. A rank directory over each bitmap (the ones before every ``BLOCK`` bits) turns the
position at one level into the position at the next, so that any token, or any range, is read
without decoding what stands before it.

The file format is a Parquet data set, one row a segment (whole documents, about
``SEGMENT_TOKENS`` tokens), so that Spark's committers and readers work on any store:

    part, segment       place of the segment: writing task, number within it
    before              tokens of the same part before the segment
    n_tokens            tokens of the segment
    doc_ids, ends       its documents and the end of each, counted from the segment's start
    chunks, bitmaps, ranks   one binary a level: bytes, packed bits, 32-bit counts

Beside it, ``starts`` has one row a part: the tokens of all parts before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import bounded_broadcast, prepare, utf8
from tabwatch.llm.tokens import encoder

CHUNK = 8
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
#: Rows of the starts table (20 bytes each) up to which it is broadcast.
MOST_STARTS = 200_000
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)

SEGMENTS = ("part int, segment int, before long, n_tokens long, doc_ids array<long>, ends array<long>, "
            "chunks array<binary>, bitmaps array<binary>, ranks array<binary>")
DOCUMENTS = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels of ``ids`` (unsigned): chunks, continuation bitmaps, rank directories."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint64)
    while True:
        chunks.append((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8).tobytes())
        more = (rest >> np.uint64(CHUNK)) > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = _ONES[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        if not more.any():
            return chunks, bitmaps, ranks
        rest = rest[more] >> np.uint64(CHUNK)


class Segment:
    """Random access to one segment's ids."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(x, np.uint8) for x in chunks]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def rank(self, level: int, i: int) -> int:
        """Ones of a level's bitmap before position i: a directory entry and at most one block."""
        if i // BLOCK >= len(self.ranks[level]):
            return int(self.ranks[level][-1]) + int(_ONES[self.bitmaps[level][-(BLOCK // 8):]].sum()) if i else 0
        first, byte = (i // BLOCK) * (BLOCK // 8), i // 8
        ones = int(_ONES[self.bitmaps[level][first:byte]].sum())
        if i % 8:
            ones += int(_ONES[self.bitmaps[level][byte] & ((1 << (i % 8)) - 1)])
        return int(self.ranks[level][i // BLOCK]) + ones

    def token(self, i: int) -> int:
        """The id at position i; one rank a level."""
        value, shift = 0, 0
        for level, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << shift
            if not (self.bitmaps[level][i // 8] >> (i % 8)) & 1:
                break
            i, shift = self.rank(level, i), shift + CHUNK
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids of positions lo to hi; reads those positions alone at every level."""
        out = self.chunks[0][lo:hi].astype("<u4")
        at, shift = np.arange(hi - lo), 0
        for level in range(len(self.chunks) - 1):
            bits = np.unpackbits(self.bitmaps[level][lo // 8:(hi + 7) // 8], bitorder="little")
            at = at[bits[lo % 8:lo % 8 + hi - lo].astype(bool)]
            lo = self.rank(level, lo)
            hi, shift = lo + len(at), shift + CHUNK
            out[at] |= self.chunks[level + 1][lo:hi].astype("<u4") << np.uint32(shift)
        return out


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: bytes, most: int) -> Iterator[pa.RecordBatch]:
    enc, part = encoder(path), TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()),
                        ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                        *[(c, pa.list_(pa.binary())) for c in ("chunks", "bitmaps", "ranks")]])
    docs, ends, ids, n, before, segment = [], [], [], 0, 0, 0

    def close() -> pa.RecordBatch:
        levels = pack(np.frombuffer(b"".join(ids), "<u4"))
        return pa.RecordBatch.from_pylist([{
            "part": part, "segment": segment, "before": before, "n_tokens": n, "doc_ids": docs, "ends": ends,
            "chunks": levels[0], "bitmaps": levels[1], "ranks": levels[2]}], schema=schema)

    for batch in batches:
        for doc, found in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1))):
            own = found.tobytes() + end
            docs.append(doc)
            ids.append(own)
            n += len(own) // 4
            ends.append(n)
            if n >= most:
                yield close()
                docs, ends, ids, n, before, segment = [], [], [], 0, before + n, segment + 1
    if docs:
        yield close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id long, text string) into ``folder``/segments and ``folder``/starts.

    Documents are dealt out in ranges of (doc_id, hash of the text), so that parts follow each
    other in ascending doc_id; null ids come first, rows that share an id stand side by side, a
    null text has the end id alone, and an empty table gives no segment. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    end = int(end_id).to_bytes(4, "little")
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
             .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
             .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text")))
    rows = dealt.mapInArrow(lambda batches: _segments(batches, tokenizer, end, segment_tokens), SEGMENTS)
    rows.write.parquet(f"{folder}/segments")
    # one row for each part, as many as the writer had tasks
    totals = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").groupBy("part").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("segments"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("start"), "n", "segments").write.parquet(
        f"{folder}/starts")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            seg = Segment(row["chunks"], row["bitmaps"], row["ranks"])
            ends = np.array(row["ends"], np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            ids = memoryview(seg.tokens(0, len(seg)).tobytes())
            crc = [zlib.crc32(ids[4 * lo:4 * hi]) for lo, hi in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                pa.array(starts + row["before"]), pa.array(ends - starts), pa.array(crc, pa.int64())], schema=schema)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of ``write_tokens``."""
    starts = spark.read.parquet(f"{folder}/starts")
    rows = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").mapInArrow(_documents, DOCUMENTS)
    starts = bounded_broadcast(starts.select("part", "start"), starts.count(), MOST_STARTS)
    return rows.join(starts, "part").select(
        "doc_id", (F.col("start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, first: int, n: int) -> list[int]:
    """n ids from global position ``first`` on: opens the segments that hold them, nothing else."""
    starts = spark.read.parquet(f"{folder}/starts").where((F.col("start") < first + n) & (F.col("start") + F.col("n") > first))
    at = F.col("start") + F.col("before")
    rows = (spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").join(F.broadcast(starts.select("part", "start")), "part")
            .where((at < first + n) & (at + F.col("n_tokens") > first)).withColumn("at", at).orderBy("at"))
    out: list[int] = []
    for row in rows.select("at", "n_tokens", "chunks", "bitmaps", "ranks").toLocalIterator():
        seg = Segment(row["chunks"], row["bitmaps"], row["ranks"])
        out += seg.tokens(max(0, first - row["at"]), min(row["n_tokens"], first + n - row["at"])).tolist()
    return out
