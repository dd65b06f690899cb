"""Token counts of whole texts; huge documents are counted in overlapping chunks.

A text of more than ``chunk`` characters is cut into chunks that overlap, the chunks are dealt
over the cluster, and each is encoded with offsets. Two neighbours are spliced at a common
boundary: an offset inside the overlap at which both start a piece of the vocabulary's pattern.
The pattern is matched from left to right and a match depends on nothing before its start, so
behind a common start both chunks go on alike, and the whole text does too. Offsets within
``margin`` of a chunk's end are not used: there a cut special string, or a run that the cut
ends, could show a boundary that the whole text lacks. A text with a seam that has no common
boundary is counted again with an overlap (and chunks) ``WIDER`` times as large, until one chunk
holds it.

tokens = sum over chunks - sum over seams (left chunk's ids after the splice + right chunk's
ids before it), so that a document's chunks never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, tasks, utf8, written
from tabwatch.llm.tokens import encoder

CHUNK_CHARS = 16_384
OVERLAP = 256
WIDER = 8
_CHUNKS = "row long, doc_id long, text_hash long, n_bytes long, chunk int, last boolean, begin long, text binary"
_SEAMS = ("row long, doc_id long, text_hash long, n_bytes long, seam int, side int, tokens long, at array<long>, "
          "before array<long>")
_COUNTS = "doc_id long, n_bytes long, n_tokens long"


def _sentence_piece(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(model.encode(x.as_buffer().to_pybytes().decode("utf-8", "replace"), num_threads=1)) for x in texts]


def _whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = _sentence_piece(path) if path.endswith(".model") else lambda texts, enc=encoder(path): list(map(len, enc.batch(texts)))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(count(batch.column(1)), pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"])


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()),
                        ("chunk", pa.int32()), ("last", pa.bool_()), ("begin", pa.int64()), ("text", pa.binary())])
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            whole, row, rows = raw.decode("utf-8", "replace"), row + 1, []
            for k, begin in enumerate(range(0, max(1, len(whole) - overlap), chunk)):
                piece = whole[begin:begin + chunk + overlap]
                rows.append((row, doc, text_hash, len(raw), k, begin + len(piece) == len(whole), begin, piece.encode()))
                if rows[-1][5]:
                    break
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows[lo:lo + 256]), schema)], schema=schema)


def _encode(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    margin = 1 + max([0, *map(len, enc.special)])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()),
                        ("seam", pa.int32()), ("side", pa.int32()), ("tokens", pa.int64()),
                        ("at", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text, k, begin = r["text"].decode("utf-8", "replace"), r["chunk"], r["begin"]
            at, before = enc.boundaries(text)
            own, total = (r["row"], r["doc_id"], r["text_hash"]), int(before[-1])
            out.append((*own, r["n_bytes"], -1, 0, total, [], []))
            # the overlap is the chunk's first characters (side 2) and those behind ``chunk`` (side 1)
            ends = [(k - 1, 2, 0, overlap)] * (k > 0) + [(k, 1, chunk, chunk + overlap)] * (not r["last"])
            for seam, side, lo, hi in ends:
                use = (at >= lo + margin) & (at <= min(hi, len(text)) - margin)
                out.append((*own, 0, seam, side, total, (at[use] + begin).tolist(), before[use].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _count_long(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_tokens, open (a seam without a common boundary) of each row."""
    cut = texts.mapInArrow(lambda b: _cut(b, chunk, overlap), _CHUNKS)
    dealt = cut.repartition(4 * tasks(texts.sparkSession), "row", "chunk")
    rows = written(dealt.mapInArrow(lambda b: _encode(b, path, chunk, overlap), _SEAMS), "token-chunks")
    own = ["row", "doc_id", "text_hash"]
    side = lambda n: F.max(F.when(F.col("side") == n, F.struct("at", "before", "tokens")))
    seams = rows.where("seam >= 0").groupBy(*own, "seam").agg(side(1).alias("l"), side(2).alias("r"))
    seams = seams.withColumn("splice", F.array_max(F.array_intersect("l.at", "r.at")))
    ids = lambda s: F.element_at(f"{s}.before", F.array_position(f"{s}.at", F.col("splice")).cast("int"))
    seams = seams.select(*own, F.lit(0).cast("long").alias("n_bytes"),
                         F.when(F.col("splice").isNotNull(), ids("l") - F.col("l.tokens") - ids("r")).alias("tokens"),
                         F.col("splice").isNull().cast("int").alias("open"))
    parts = rows.where("seam < 0").select(*own, "n_bytes", "tokens", F.lit(0).alias("open")).union(seams)
    return parts.groupBy(*own).agg(F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"),
                                   F.max("open").alias("open")).drop("row")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id long, text string).

    A null text counts as empty (0 bytes, 0 tokens). Rows are counted each on its own: repeated
    rows and repeated or null ids stay. Other columns are ignored; an empty table gives no rows.
    Splicing is proven for the byte-level vocabulary; with another file, texts are encoded whole.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be above 0 and below the chunk")
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    spliced = tokenizer.rsplit("/", 1)[-1].startswith("byte_bpe_50k")
    short = base.where(size <= chunk + overlap) if spliced else base
    out = short.select("doc_id", utf8("text").alias("text")).mapInArrow(lambda b: _whole(b, tokenizer), _COUNTS)
    left = base.where(size > chunk + overlap).select("doc_id", F.xxhash64("text").alias("text_hash"),
                                                    utf8("text").alias("text")) if spliced else None
    while left is not None:
        counted = written(_count_long(left, tokenizer, chunk, overlap), "token-counts")
        out = out.union(counted.where("open = 0").select("doc_id", "n_bytes", "n_tokens"))
        again = counted.where("open = 1").select("text_hash").distinct()
        chunk, overlap = chunk * WIDER, overlap * WIDER
        left = left.join(again, "text_hash", "left_semi").select("doc_id", "text_hash", "text") if again.take(1) else None
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
