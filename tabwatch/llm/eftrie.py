"""Language-model scores from an Elias-Fano n-gram trie, sharded over the vocabulary.

The model is a bigram model with Dirichlet smoothing; the context v of a word w is the word before
it (the first word follows the end of a text):

    P(w | v) = (c(v w) + MU * P1(w)) / (c(v) + MU),    P1(w) = (c(w) + 1) / (N + V + 1)

c counts the training tokens (words, and an end for each text), N is their number and V that of
their distinct words. It sums to one over the known words and one unknown.

1. One pass counts N and c(w) of the few hot words (found in a sample of the rows; the list only
   steers the load), and sends the distinct words of each chunk of documents to parts by hash,
   which count V.
2. A second pass sends each token as (word, context, document) to the shard of its word, packed by
   chunk; hot words are spread over all shards by (word, context). A shard adds up c(w) and c(v w)
   over all chunks and builds its trie: contexts, the words seen behind each as small ids relative
   to the shard, monotone pointers from one to the other, all in Elias-Fano code, and numerators
   quantised to 16 bits. The levels lie in one memory-mapped file. Every token is then looked up
   by a search among the successors of its own context.
   The denominators need no c(v) there: each token but the end of a text is the context of the
   next, and the end stands before the first, so the contexts of a text are its tokens, and each
   shard subtracts log10(c(w) + MU) of its own words instead.
3. The sums of each chunk's documents come back and are added.

Words are known by 64-bit hashes. What is sent grows with the text; nothing of it passes through
the driver, and a task holds one chunk or one shard.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import gives_back, prepare, tasks, utf8, written

MU = 8.0
#: Contexts are told apart by all 64 bits of the hash.
CLASSES = 1 << 64
CHUNK_TOKENS = 1_000_000
CHUNK_DOCS = 30_000
SHARD_TOKENS = 2_000_000
#: Pairs that a shard looks up at once.
FOUND = 1 << 18
#: One row in SAMPLED is looked at for hot words; a hot word has more than this share of them.
SAMPLED = 64
HOT_SHARE = 1 / 500
CODES = (1 << 16) - 1
LEAST = -24.0  # log10 of the smallest probability that a code stands for
END = 0x9E3779B97F4A7C15  # stands for the end of a text
_U = np.uint64


class EliasFano:
    """A sorted sequence of unsigned integers in compact form: low bytes plain, the rest in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width = n, width
        self.low = low.reshape(n, width)
        self.ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
        """(length, low bytes of a value, low part, unary part)."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(7, ((top // max(1, n)).bit_length() + 7) // 8)
        low = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(n, 8)[:, :width]
        at = (values >> _U(8 * width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) if n else 0) + 1, bool)
        bits[at] = True
        return n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes()

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        low = np.zeros((len(i), 8), np.uint8)
        low[:, :self.width] = self.low[i]
        return ((self.ones[i] - i).astype(np.uint64) << _U(8 * self.width)) | low.view("<u8")[:, 0]

    def search(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each value the first position in [lo, hi) that holds it or more (hi: none)."""
        lo, hi = lo.copy(), hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            middle = (lo[todo] + hi[todo]) >> 1
            less = self.get(middle) < values[todo]
            lo[todo[less]] = middle[less] + 1
            hi[todo[~less]] = middle[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


class Trie:
    """Contexts -> pointers -> successors -> quantised log probabilities."""

    def __init__(self, file, words: int):
        self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.words = words
        head = np.frombuffer(self.map, "<i8", 13)
        parts, at = [], head.nbytes
        for size in head[:7].tolist():
            parts.append(np.frombuffer(self.map, np.uint8, size, at))
            at += size
        level = [EliasFano(*head[7 + 2 * k:9 + 2 * k].tolist(), *parts[2 * k:2 * k + 2]) for k in range(3)]
        self.contexts, self.pointers, self.successors = level
        self.codes = parts[6].view("<u2")

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, log10: np.ndarray, words: int) -> "Trie":
        """From distinct pairs sorted by (context, successor); successors are below ``words``."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        key *= words
        key += successor
        levels = [EliasFano.encode(x.astype(np.uint64, copy=False)) for x in (
            context[first], np.append(first, len(context)), key.view(np.uint64))]  # one sequence for all contexts
        codes = np.clip(np.round((log10 / LEAST) * CODES), 0, CODES).astype("<u2").tobytes()
        parts = [p for x in levels for p in x[2:]] + [codes]
        head = np.array([*map(len, parts), *[v for x in levels for v in x[:2]]], "<i8")
        with tempfile.TemporaryFile() as file:  # of this task alone, and gone with it
            file.writelines([head.tobytes(), *parts])
            file.flush()
            return cls(file, words)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """log10 probability of each pair, nan where it was not seen."""
        out = np.full(len(context), np.nan)
        if not self.contexts.n:
            return out
        own, of = np.unique(context, return_inverse=True)
        rank = self.contexts.search(own.astype(np.uint64), np.zeros(len(own), np.int64), np.full(len(own), self.contexts.n))
        known = np.minimum(rank, self.contexts.n - 1)
        known = np.where((rank < self.contexts.n) & (self.contexts.get(known) == own.astype(np.uint64)), known, -1)
        lo, hi = (self.pointers.get(np.maximum(known, 0) + k).astype(np.int64) for k in (0, 1))
        at = np.flatnonzero(known[of] >= 0)
        mine = of[at]
        wanted = (known[mine] * self.words + successor[at]).astype(np.uint64)
        place = self.successors.search(wanted, lo[mine], hi[mine])
        there = place < hi[mine]
        there[there] = self.successors.get(place[there]) == wanted[there]
        out[at[there]] = self.codes[place[there]] * (LEAST / CODES)
        return out


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words and its end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a task's documents: ids, held out or not, lengths, tokens."""
    ids, held, parts, n = [], [], [], 0
    for b in batches:
        for doc, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            ids.append(doc)
            held.append(out)
            parts.append(tokens(text.as_buffer().to_pybytes()))
            n += len(parts[-1])
            if n >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                yield ids, np.array(held), np.array(list(map(len, parts))), np.concatenate(parts)
                ids, held, parts, n = [], [], [], 0
    if ids:
        yield ids, np.array(held), np.array(list(map(len, parts))), np.concatenate(parts)


def _rows(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


@gives_back
def _totals(batches: Iterator[pa.RecordBatch], hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, its distinct words) of each chunk, and (-1, training tokens and hot counts) of a task."""
    own = np.zeros(1 + len(hot), np.int64)
    names, types = ["part", "packed"], [pa.int32(), pa.binary()]
    for _, held, lengths, found in _chunks(batches):
        found = found[~np.repeat(held, lengths)]
        if not len(found):
            continue
        words, n = np.unique(found, return_counts=True)
        own[0] += len(found)
        at = np.minimum(np.searchsorted(words, hot), len(words) - 1)
        own[1:] += np.where(words[at] == hot, n[at], 0)
        part = ((words >> _U(24)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        words, cuts = words[order], np.searchsorted(part[order], np.arange(parts + 1))
        for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if lo < hi:
                yield _rows([[k], [words[lo:hi].tobytes()]], names, types)
    yield _rows([[-1], [own.astype("<i8").tobytes()]], names, types)


@gives_back
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part -> the number of distinct words of each part, and (with part -1) the added counts."""
    names, types = ["distinct", "counts"], [pa.int64(), pa.binary()]
    at, total, words, more, n = None, 0, np.empty(0, np.uint64), [], 0

    def done() -> pa.RecordBatch:
        if at < 0:
            return _rows([[0], [total.tobytes()]], names, types)
        return _rows([[len(np.unique(np.concatenate([words, *more])))], [None]], names, types)

    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != at:
                if at is not None:
                    yield done()
                at, total, words, more, n = k, 0, np.empty(0, np.uint64), [], 0
            if k < 0:
                total = total + np.frombuffer(raw, "<i8")
                continue
            more.append(np.frombuffer(raw, "<u8"))
            n += len(more[-1])
            if n > max(len(words), SHARD_TOKENS):  # what waits stays in proportion to the distinct words
                words, more, n = np.unique(np.concatenate([words, *more])), [], 0
    if at is not None:
        yield done()


@gives_back
def _hot_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held, lengths, found in _chunks(batches):
        words, n = np.unique(found, return_counts=True)
        many = n > len(found) * HOT_SHARE / 2
        yield _rows([np.append(words[many].view(np.int64), 0), np.append(n[many], len(found)), np.append(np.zeros(many.sum(), bool), True)],
                    ["word", "n", "all"], [pa.int64(), pa.int64(), pa.bool_()])


@gives_back
def _sent(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, chunk, packed occurrences), and (-1, chunk, ids and held) for each chunk.

    Packed: numbers of words, pairs and occurrences; each word's hash and pairs; each pair's context
    and documents; each occurrence's document (top bit: held out) and how often it is there.
    """
    names, types = ["shard", "chunk", "packed", "doc_ids"], [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    for k, (ids, held, lengths, found) in enumerate(_chunks(batches)):
        chunk = TaskContext.get().partitionId() * (1 << 24) + k
        doc = np.repeat(np.arange(len(ids), dtype=np.uint16), lengths)
        context = np.empty_like(found)
        context[1:] = found[:-1]
        context[np.cumsum(lengths) - lengths] = END
        shard = ((found >> _U(40)) % _U(shards)).astype(np.int32)
        spread = np.flatnonzero(np.isin(found, hot))
        shard[spread] = ((found[spread] + context[spread] * _U(0xBF58476D1CE4E5B9)) >> _U(32)) % _U(shards)
        yield _rows([[-1], [chunk], [(held.astype("u1").tobytes() + lengths.astype("<i8").tobytes())], [ids]], names, types)
        order = np.lexsort((context, found, shard))  # stable: documents stay in order
        shard = shard[order]
        found = found[order]
        context = context[order]
        doc = doc[order]
        del order, spread
        new_word = np.append(True, (found[1:] != found[:-1]) | (shard[1:] != shard[:-1]))
        new_pair = new_word | np.append(True, context[1:] != context[:-1])
        new_doc = new_pair | np.append(True, doc[1:] != doc[:-1])
        times = np.diff(np.append(np.flatnonzero(new_doc), len(doc))).astype("<u4")
        new_word, new_pair, shard, doc = new_word[new_doc], new_pair[new_doc], shard[new_doc], doc[new_doc]
        found = found[new_doc]
        context = context[new_doc]
        doc |= np.where(held[doc], 1 << 15, 0).astype(np.uint16)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if lo == hi:
                continue
            w, p = np.flatnonzero(new_word[lo:hi]), np.flatnonzero(new_pair[lo:hi])
            pairs = np.diff(np.append(np.searchsorted(p, w), len(p)))
            docs = np.diff(np.append(p, hi - lo))
            packed = b"".join([np.array([len(w), len(p), hi - lo], "<i8").tobytes(), found[lo:hi][w].tobytes(),
                               _planes(pairs), context[lo:hi][p].tobytes(), _planes(docs),
                               doc[lo:hi].astype("<u2").tobytes(), _planes(times[lo:hi])])
            yield _rows([[s], [chunk], [packed], [None]], names, types)


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers, first all their lowest bytes: most are small, and the rest compresses to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> list[np.ndarray]:
    words, pairs, n = np.frombuffer(raw, "<i8", 3).tolist()
    out, at = [], 24
    for kind, size in (("<u8", words), ("<u4", words), ("<u8", pairs), ("<u4", pairs), ("<u2", n), ("<u4", n)):
        if kind == "<u4":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4")[:, 0])
        else:
            out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out


def _shard_scores(chunks: list[int], packed: list[bytes], hot: np.ndarray, hot_counts: np.ndarray, known: float) -> Iterator[tuple]:
    """(chunk, documents, known tokens, sum of log10(c + 1), log10 of the numerators of P less log10(c + MU))."""
    words, pairs, contexts, counts = [], [], [], []
    for raw in packed:  # occurrences are unpacked a chunk at a time, here and below
        own, pairs_of, before, docs, d, times = _unpack(raw)
        words.append(own)
        pairs.append(pairs_of)
        contexts.append(before)
        counts.append(np.add.reduceat(np.where(d < 1 << 15, times, 0), np.cumsum(docs, dtype=np.int64) - docs))
    del own, pairs_of, before, docs, d, times
    hashes = np.unique(np.concatenate(words))
    word = np.concatenate([np.repeat(np.searchsorted(hashes, own).astype(np.int32), n) for own, n in zip(words, pairs)])  # of each pair
    pair_count = np.concatenate(counts)
    own_contexts = np.unique(np.concatenate(contexts))
    context = np.concatenate([np.searchsorted(own_contexts, x).astype(np.int32) for x in contexts])
    del words, pairs, contexts, counts
    count = np.bincount(word, weights=pair_count, minlength=len(hashes))
    place = np.minimum(np.searchsorted(hot, hashes), max(0, len(hot) - 1))
    is_hot = hot[place] == hashes if len(hot) else np.zeros(len(hashes), bool)
    if len(hot):
        count = np.where(is_hot, hot_counts[place], count)
    one = (count + 1) / known
    trie, top = _trie(own_contexts, context, word, pair_count, one)
    del pair_count
    value = np.empty(len(word))
    for lo in range(0, len(word), FOUND):
        own = slice(lo, lo + FOUND)
        value[own] = trie.find(own_contexts[context[own]], word[own])
    del trie, context, own_contexts
    value += top
    unseen = np.flatnonzero(np.isnan(value))
    value[unseen] = np.log10(MU * one[word[unseen]])
    value -= np.log10(count + MU)[word]  # stands for the context's: see above
    base, is_known = np.log10(count + 1), count > 0
    pair = 0
    for chunk, raw in zip(chunks, packed):
        *_, each, d, n = _unpack(raw)
        own = slice(pair, pair + len(each))
        pair = own.stop
        of = np.repeat(np.arange(own.start, own.stop), each)
        docs, d = np.unique(d & 0x7FFF, return_inverse=True)
        add = lambda x: np.bincount(d, weights=n * x, minlength=len(docs))  # noqa: E731,B023
        yield chunk, docs, add(is_known[word[of]]), add(base[word[of]]), add(value[of])


def _trie(contexts: np.ndarray, context: np.ndarray, word: np.ndarray, pair_count: np.ndarray, one: np.ndarray) -> tuple[Trie, float]:
    """The trie of the pairs that were seen in training, and what its codes leave out of the logarithms."""
    key = context[pair_count > 0].astype(np.int64)
    key *= len(one)
    key += word[pair_count > 0]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    both = np.add.reduceat(pair_count[pair_count > 0][order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    key = key[first]
    del order, new, first
    value = (key % len(one)).astype(np.int32)
    key //= len(one)
    both = both + MU * one[value]
    top = float(np.log10(max(1.0, both.max(initial=0))))  # codes stand for logarithms up to 0
    return Trie.build(contexts[key], value, np.log10(both) - top, len(one)), top


@gives_back
def _shards(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hot_counts: np.ndarray, known: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, chunk) -> sums of each (shard, chunk); rows of shard -1 pass through."""
    names = ["chunk", "sums", "packed", "doc_ids"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    at, chunks, packed = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        for chunk, docs, *sums in _shard_scores(chunks, packed, hot, hot_counts, known):
            raw = b"".join(x.astype(kind).tobytes() for x, kind in zip((docs, *sums), ("<u2", "<u4", "<f8", "<f4")))
            yield _rows([[chunk], [raw], [None], [None]], names, types)

    for b in batches:
        for shard, chunk, raw, ids in zip(*(c.to_pylist() for c in b.columns)):
            if shard < 0:
                yield _rows([[chunk], [None], [raw], [ids]], names, types)
                continue
            if shard != at:
                if chunks:
                    yield from done()
                at, chunks, packed = shard, [], []
            chunks.append(chunk)
            packed.append(raw)
    if chunks:
        yield from done()


@gives_back
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, its documents first -> one row a document."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    own, total = None, None

    def done() -> pa.RecordBatch:
        ids, held, lengths = own
        return _rows([ids, held, lengths, np.rint(total[0]).astype(np.int64), total[1], total[2]], names, types)

    for b in batches:
        for ids, raw, sums in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if ids is not None:
                if own is not None:
                    yield done()
                own = ids, np.frombuffer(raw, "u1", len(ids)).astype(bool), np.frombuffer(raw, "<i8", len(ids), len(ids))
                total = np.zeros((3, len(ids)))
                continue
            n = len(sums) // 18
            docs = np.frombuffer(sums, "<u2", n)
            for k, (kind, at) in enumerate((("<u4", 2), ("<f8", 6), ("<f4", 14))):
                total[k, docs] += np.frombuffer(sums, kind, n, at * n)
    if own is not None:
        yield done()


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``docs`` has doc_id (long), text (string) and held_out (boolean): held-out rows are scored but
    not learned from. A null text is empty: its end alone. Rows that repeat, share an id or have
    none stay rows and are all learned from; a null held_out is false; other columns are ignored;
    an empty table gives no rows. base_score is the sum of log10((c + 1) / (N + V + 1)).
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"),
                        utf8("text").alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(_hot_sample, "word long, n long, all boolean")
    sample = sample.groupBy("word", "all").agg(F.sum("n").alias("n")).orderBy(F.desc("all"), F.desc("n")).limit(1 + int(2 / HOT_SHARE)).collect()
    looked = sum(r["n"] for r in sample if r["all"])
    hot = np.array(sorted(r["word"] & ((1 << 64) - 1) for r in sample if not r["all"] and r["n"] > looked * HOT_SHARE), np.uint64)

    parts = tasks(spark)
    totals = texts.mapInArrow(lambda b: _totals(b, hot, parts), "part int, packed binary")
    totals = totals.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        _added, "distinct long, counts binary").collect()  # one row a part, and one of counts
    n_distinct = sum(r["distinct"] for r in totals)
    counts = sum((np.frombuffer(r["counts"], "<i8") for r in totals if r["counts"] is not None), np.zeros(1 + len(hot), np.int64))
    n_train, hot_counts = int(counts[0]), counts[1:]
    shards = max(1, -(-n_train // SHARD_TOKENS))
    model = spark.sparkContext.broadcast((hot, hot_counts, n_train + n_distinct + 1.0))

    sent = texts.mapInArrow(lambda b: _sent(b, shards, hot), "shard int, chunk long, packed binary, doc_ids array<long>")
    deal = F.when(F.col("shard") < 0, F.xxhash64("chunk")).otherwise(F.col("shard").cast("long"))
    summed = (sent.repartition(max(tasks(spark), shards), deal).sortWithinPartitions("shard", "chunk")
              .mapInArrow(lambda b: _shards(b, *model.value), "chunk long, sums binary, packed binary, doc_ids array<long>"))
    summed = written(summed, "lm-sums")
    rows = (summed.select("chunk", "doc_ids", "packed", "sums").repartition(tasks(spark), "chunk")
            .sortWithinPartitions("chunk", F.col("doc_ids").isNull())
            .mapInArrow(_gather, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                       (F.col("log_counts") - F.col("n_tokens") * float(np.log10(n_train + n_distinct + 1))).alias("base_score"), "score")
