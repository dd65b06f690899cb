"""Best-fit packing of token sequences, planned over the histogram of lengths.

The plan is made on counts, not on documents: at most ``size`` lengths, so a driver-side loop
over them is bounded whatever the data. Lengths are placed from the longest down, each into the
sequences with the least room that holds it; sequences with equal room form one range and are
filled together. The plan is a list of slots "ranks lo..hi of length L go to sequences
first..first+hi-lo, at offset o". Every piece then finds its slot by its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import bounded_broadcast, gives_back, prepare, utf8, written
from tabwatch.llm.tokens import encoder, forget

#: Rows of one length that are ranked together in a task.
RANKED = 200_000
#: Texts that are encoded at once.
ENCODED = 500
#: Rows of the offsets table (24 bytes each) up to which it is broadcast.
MOST_OFFSETS = 200_000
_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) slots for ``counts`` of each length."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of sequences (first, how many)
    rooms: list[int] = []  # keys of room, ascending
    slots, opened = [], 0

    def give(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(rooms, free)
                room[free] = []
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                free = rooms[k]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(k)
                take = min(n, left)
                slots.append((length, rank, rank + take - 1, first, size - free))
                give(free - length, first, take)
                give(free, first + take, n - take)
                rank, left = rank + take, left - take
            else:
                fit = size // length
                full, rest = divmod(left, fit)
                for n, each in ((full, fit), (min(rest, 1), rest)):
                    for j in range(each if n else 0):
                        slots.append((length, rank, rank + n - 1, opened, j * length))
                        rank += n
                    give(size - each * length, opened, n)
                    opened += n
                left = 0
    return slots


@gives_back
def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: bytes) -> Iterator[pa.RecordBatch]:
    enc, uid = encoder(path), TaskContext.get().partitionId() << 40
    types = [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
             ("length", pa.int64()), ("ids_crc32", pa.int64())]
    for batch in (b.slice(at, ENCODED) for b in batches for at in range(0, b.num_rows, ENCODED)):
        out = []
        for doc, found in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1))):
            ids = memoryview(found.tobytes() + end)
            for piece, lo in enumerate(range(0, len(ids), 4 * size)):
                own = ids[lo:lo + 4 * size]
                out.append((uid, doc, piece, lo // 4, len(own) // 4, zlib.crc32(own)))
                uid += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), types)], schema=pa.schema(types))
    forget(path)


def pack_documents(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    A document is the ids of its text (null: empty) and ``end_id``; one longer than ``size`` is cut
    into pieces of ``size``. Repeated rows are packed as often as they occur (their pieces take
    slots in any order); null ids stay; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    end = int(end_id).to_bytes(4, "little")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    pieces = written(texts.mapInArrow(lambda b: _pieces(b, tokenizer, size, end), _PIECES), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    # rank within the length: a length with many rows is ranked in several buckets, behind each other
    buckets = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.col("uid") % F.col("buckets"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    offsets = bounded_broadcast(offsets, sum(-(-n // RANKED) for n in counts.values()), MOST_OFFSETS)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1)
    ranked = ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ranked_before"))
    slots = spark.createDataFrame(best_fit_plan(counts, size), "slot_length long, lo long, hi long, first long, offset long")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("lo"), F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
