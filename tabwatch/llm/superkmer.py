"""Repeated passages through super-k-mers.

A window is ``n`` consecutive words of one document. Its minimiser is the smallest of its runs of
``MINIMISER`` words in a fixed order: by hash, those that very many windows would share last.
Consecutive windows with the same minimiser form a super-k-mer, one packed string of words, and
travel as one row to the bucket of their minimiser; equal windows have equal minimisers and meet
there. A bucket hashes every window of its strings, sorts the hashes and compares windows of equal
hash word for word, so that counts are exact. A string with a window that starts anywhere else
goes back by its 128-bit digest to the documents that hold it.

Order of minimisers: a first pass counts, over all documents, the super-k-mers of each minimiser;
one with more than 1 / 2^HOT_BITS of them (and LEAST_HOT) is late in the order, so that a line
found everywhere is keyed by what stands beside it. At most 2^HOT_BITS hashes are sent along.
The order only steers the load: any order gives the same windows.

Copies: a task sends a string at most twice, whatever its copies in that task; the digest of the
whole text is the key of the way back, so copies of a document share one entry.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, tasks, utf8, written
from tabwatch.llm.tgm import FILTER_BITS, _filter, _mix

#: Words of a minimiser (fewer for windows of fewer words).
MINIMISER = 4
#: Windows of one super-k-mer; longer runs (a line repeated) are cut.
MOST_WINDOWS = 128
HOT_BITS = 16
LEAST_HOT = 2000
#: Bytes of strings that a bucket task counts at once (whole minimisers).
BUCKET_BYTES = 2 << 20
#: Strings that a task remembers having sent.
REMEMBERED = 1 << 18
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


class Strings:
    """Super-k-mers of the texts of a batch: arrays ``doc``, ``first`` (word in its document),
    ``words``, ``minimiser``; ``packed(i)`` is the i-th as bytes."""

    def __init__(self, texts: list[bytes], n: int, late: np.ndarray):
        split = [t.split() for t in texts]
        flat = list(chain.from_iterable(split))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(counts)
        total, m = len(flat), min(MINIMISER, n)
        self.doc = self.first = self.words = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.int64)
        if total < n or not (counts >= n).any():
            return
        self.text = b" ".join(flat)
        self.at = np.zeros(total + 1, np.int64)
        np.cumsum(np.fromiter(map(len, flat), np.int64, total) + 1, out=self.at[1:])
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, total)
        grams = np.zeros(total - m + 1, np.uint64)
        for i in range(m):
            grams = grams * _ODD + ids[i:total - m + 1 + i]
        grams = _mix(grams) >> _U(1)
        if len(late):
            grams |= np.isin(grams, late).astype(np.uint64) << _U(63)
        # smallest of each n - m + 1 neighbours, by doubling
        least, span, width = grams, 1, n - m + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
        owner = np.repeat(np.arange(len(split)), counts)[:total - n + 1]
        whole = np.flatnonzero(np.arange(n, total + 1) <= ends[owner])  # windows inside one document
        new = np.ones(len(whole), bool)
        new[1:] = (np.diff(whole) != 1) | (least[whole[1:]] != least[whole[:-1]]) | (owner[whole[1:]] != owner[whole[:-1]])
        begin = np.flatnonzero(new)
        within = np.arange(len(whole)) - np.repeat(begin, np.diff(np.append(begin, len(whole))))
        begin = np.flatnonzero(within % MOST_WINDOWS == 0)
        self.start = whole[begin]
        self.words = np.diff(np.append(begin, len(whole))) + n - 1
        self.doc = owner[self.start]
        self.first = self.start - (ends - counts)[self.doc]
        self.minimiser = least[self.start].view(np.int64)

    def packed(self, i: int) -> bytes:
        s = self.start[i]
        return self.text[self.at[s]:self.at[s + self.words[i]] - 1]


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of each minimiser, where a task sees it more than once, and of all (null)."""
    none, held, total = np.zeros(0, np.uint64), [], 0
    for b in batches:
        held.append(Strings(_texts(b.column(0)), n, none).minimiser)
        total += len(held[-1])
    keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    often = counts >= max(2, total >> (HOT_BITS + 2))
    yield pa.RecordBatch.from_arrays([pa.array([None, *keys[often].tolist()], pa.int64()),
                                      pa.array([total, *counts[often].tolist()], pa.int64())], names=["minimiser", "n"])


def _send(batches: Iterator[pa.RecordBatch], n: int, late: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(minimiser, packed, many): each string of a task at most twice, or once with ``many``."""
    sent: dict[bytes, bool] = {}  # digest -> sent twice
    for b in batches:
        s, rows = Strings(_texts(b.column(0)), n, late), {}
        keys = s.minimiser.tolist()
        for i, key in enumerate(keys):
            packed = s.packed(i)
            rows[packed] = (key, packed in rows)
        out = []
        if len(sent) > REMEMBERED:
            sent = {}
        for packed, (key, many) in rows.items():
            digest = xxhash.xxh3_128_digest(packed)
            before = sent.get(digest)
            if before:
                continue
            sent[digest] = many or before is not None
            out.append((key, packed, many))
        columns = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                                          pa.array(columns[2], pa.bool_())], names=["minimiser", "packed", "many"])


def repeated(strings: list[bytes], many: np.ndarray, n: int) -> list[np.ndarray]:
    """For each string the flags of its windows: does the window start anywhere else (in another
    string or place, or is the string itself there more than once)?"""
    text = b" ".join(strings)
    raw = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    begin, end = np.append(0, gaps + 1), np.append(gaps, len(raw))
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.searchsorted(begin, np.cumsum(lengths + 1) - lengths - 1)
    windows = np.diff(np.append(first, len(begin))) - n + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    word = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
    a, b = begin[word], end[word + n - 1]
    # polynomial hash of every window, from prefix sums over the bytes (modulo 2^64)
    power = np.full(len(raw) + 1, _ODD)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * power[:-1], out=sums[1:])
    hashes = _mix((sums[b] - sums[a]) * power[len(raw) - a])
    flags = many[owner]
    order = np.argsort(hashes, kind="stable")
    same = np.append(hashes[order[1:]] == hashes[order[:-1]], False)
    edges = np.flatnonzero(np.diff(np.append(np.append(False, same), False).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        run = order[lo:hi + 1]
        found = [text[x:y] for x, y in zip(a[run].tolist(), b[run].tolist())]
        if found.count(found[0]) == len(found):
            flags[run] = True
        else:  # different windows of the same hash
            often = Counter(found)
            flags[[r for r, x in zip(run.tolist(), found) if often[x] > 1]] = True
    return np.split(flags, np.cumsum(windows)[:-1])


def spans_of(flags: np.ndarray, n: int) -> np.ndarray:
    """Words covered by flagged windows, as (from, to) pairs."""
    covered = np.zeros(len(flags) + n, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    inside = np.append(0, np.cumsum(covered)) > 0
    return np.flatnonzero(np.diff(np.append(inside, False).astype(np.int8))).astype("<i4")


def _bucket(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (minimiser, packed, many) sorted by minimiser -> digest and spans of repeated strings."""
    held: dict[bytes, bool] = {}
    size, last = 0, None

    def counted() -> pa.RecordBatch:
        strings, out = list(held), []
        if strings:
            for s, flags in zip(strings, repeated(strings, np.fromiter(held.values(), bool, len(held)), n)):
                if flags.any():
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s), "<i8")
                    out.append((int(digest[0]), int(digest[1]), spans_of(flags, n).tobytes()))
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.binary())], names=["k1", "k2", "spans"])

    for b in batches:
        for key, packed, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if key != last and size >= BUCKET_BYTES:
                yield counted()
                held, size = {}, 0
            last = key
            if packed not in held:
                size += len(packed)
                held[packed] = many
            else:
                held[packed] = True
    yield counted()


def _places(batches: Iterator[pa.RecordBatch], n: int, late: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(t, first, k1, k2) of the super-k-mers of each text that may be repeated; equal texts once a batch."""
    for b in batches:
        distinct = dict(zip(b.column(1).to_pylist(), range(b.num_rows)))
        digests = list(distinct)
        s = Strings([b.column(0)[i].as_buffer().to_pybytes() for i in distinct.values()], n, late)
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.packed(i)) for i in range(len(s.doc))), "<i8").reshape(-1, 2)
        lead = keys[:, 0].view(np.uint64) >> _U(64 - FILTER_BITS)
        hit = np.flatnonzero(bits[(lead >> _U(3)).astype(np.int64)] & (128 >> (lead & _U(7)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([
            pa.array([digests[d] for d in s.doc[hit].tolist()], pa.binary()), pa.array(s.first[hit]),
            pa.array(np.ascontiguousarray(keys[hit, 0])), pa.array(np.ascontiguousarray(keys[hit, 1]))], names=["t", "first", "k1", "k2"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, found in zip(b.column(1), b.column(2).to_pylist()):
            words = text.as_buffer().to_pybytes().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for piece in found or ():
                pairs = np.frombuffer(piece["spans"], "<i4").reshape(-1, 2) + piece["first"]
                np.add.at(gone, pairs[:, 0], 1)
                np.add.at(gone, pairs[:, 1], -1)
            gone = np.cumsum(gone) > 0
            edges = np.flatnonzero(np.diff(np.append(False, gone).astype(np.int8))).tolist()  # the last entry is never covered
            kept, at = [], 0
            for lo, hi in zip(edges[::2], edges[1::2]):
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept), [{"begin": x, "end": y} for x, y in zip(edges[::2], edges[1::2])]))
        columns = list(zip(*out)) if out else [(), (), (), ()]
        spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
            pa.array(columns[3], spans)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])


def remove_repeats(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept, spans of every row of ``docs`` (doc_id long, text string).

    A word goes if a window of ``n`` consecutive words that covers it has a word sequence that also
    starts anywhere else, in the same document or another; ``kept`` are the other words joined by
    one space, ``spans`` the removed ranges of words. Words are parted by ASCII white space and
    compared as they are. Windows are judged on the input, so every copy of a passage goes. Null,
    empty and blank texts have no words, texts of fewer than ``n`` words no window. Rows are
    documents: rows that repeat, or share an id (null ids too), are copies like any others. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    texts = rows.select("text")
    counts = written(texts.mapInArrow(lambda b: _count(b, n), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")),
                     "repeat-minimisers")
    total = (counts.where("minimiser is null").first() or {"n": 0})["n"]
    hot = counts.where(F.col("minimiser").isNotNull() & (F.col("n") > max(LEAST_HOT, total >> HOT_BITS)))
    late = np.sort(np.array([r["minimiser"] for r in hot.collect()], np.int64)).view(np.uint64)  # fewer than 2^HOT_BITS

    sent = texts.mapInArrow(lambda b: _send(b, n, late), "minimiser long, packed binary, many boolean")
    found = written(sent.repartition(tasks(spark), "minimiser").sortWithinPartitions("minimiser")
                    .mapInArrow(lambda b: _bucket(b, n), "k1 long, k2 long, spans binary"), "repeat-strings")
    bits = _filter(found.select(F.col("k1").alias("key")))
    keyed = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("t"))
    places = keyed.select("text", "t").mapInArrow(lambda b: _places(b, n, late, bits), "t binary, first long, k1 long, k2 long").distinct()
    covered = places.join(found, ["k1", "k2"]).groupBy("t").agg(F.collect_list(F.struct("first", "spans")).alias("found"))
    covered = written(covered, "repeat-places")
    out = keyed.join(covered, "t", "left").select("doc_id", "text", "found").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<begin:int,end:int>>")
    return out.withColumn("kept", F.col("kept").cast("string"))


def kept_by_brute_force(texts: list[str | None], n: int) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256 of the kept words) of a few texts, window by window; for tests."""
    split = [(t or "").encode().split() for t in texts]
    often = Counter(tuple(w[i:i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {i + j for i in range(len(w) - n + 1) if often[tuple(w[i:i + n])] > 1 for j in range(n)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
