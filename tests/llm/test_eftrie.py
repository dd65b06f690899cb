import math
from collections import Counter

import numpy as np

from helpers import documents, edge_rows
from pyspark.sql import functions as F
from tabwatch.llm import eftrie


def test_elias_fano_holds_and_finds_its_values():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (700, 3), (1000, 10 ** 6), (300, 2 ** 55)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        n_, width, low, high = eftrie.EliasFano.encode(values)
        ef = eftrie.EliasFano(n_, width, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8))
        assert ef.get(np.arange(n)).tolist() == values.tolist()
        asked = rng.integers(0, top, 50, dtype=np.uint64)
        lo, hi = np.zeros(50, np.int64), np.full(50, n)
        assert ef.search(asked, lo, hi).tolist() == np.searchsorted(values, asked).tolist()


def test_trie_finds_pairs_within_their_context_alone():
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 500) ** 2, rng.integers(0, 90, 500))})
    context, word = (np.array(x) for x in zip(*pairs))
    log10 = -rng.uniform(0, 20, len(pairs))
    trie = eftrie.Trie.build(context, word, log10, 90)
    assert np.abs(trie.find(context, word) - log10).max() <= 12 / eftrie.CODES
    other = [(c, w) for c in range(0, 3700, 37) for w in range(90) if (c, w) not in set(pairs)]
    assert np.isnan(trie.find(*(np.array(x) for x in zip(*other)))).all()


def brute(rows):
    """The model by dictionaries, with exact probabilities."""
    found = [eftrie.tokens((t or "").encode()).tolist() for _, t, _, _ in rows]
    count, both, classes = Counter(), Counter(), Counter()
    for (_, _, _, held), own in zip(rows, found):
        if not held:
            before = [eftrie.END, *own[:-1]]
            count.update(own)
            classes.update(w % eftrie.CLASSES for w in before)
            both.update((b % eftrie.CLASSES, w) for b, w in zip(before, own))
    n, v = sum(count.values()), len(count)
    out = []
    for (d, _, _, held), own in zip(rows, found):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        score = 0.0
        for b, w in zip([eftrie.END, *own[:-1]], own):
            k = b % eftrie.CLASSES
            score += math.log10((both[k, w] + eftrie.MU * (count[w] + 1) / (n + v + 1)) / (classes[k] + eftrie.MU))
        out.append((str(d), bool(held), len(own), sum(count[w] > 0 for w in own), n, base, score))
    return sorted(out)


def check(spark, rows):
    docs = documents(spark, [r[:3] for r in rows]).withColumn("held_out", F.lit(None).cast("boolean"))
    docs = spark.createDataFrame([(*r[:3], r[3], "x", "x") for r in rows], "doc_id long, text string, source string, held_out boolean, chunk string, shard string")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in eftrie.score_texts(docs).collect())
    want = brute(rows)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) <= 2e-4 * b[2] + 1e-9


def test_scores_with_several_shards(spark, monkeypatch):
    monkeypatch.setattr(eftrie, "SHARD_TOKENS", 500)
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) if x < 500), "s", k % 7 == 2) for k in range(200)]
    check(spark, rows)


def test_words_with_the_same_low_bits_are_contexts_of_their_own(spark):
    """Two words whose hashes agree in the 20 low bits, with different words behind them."""
    seen = {}
    for k in range(10_000):
        word = f"v{k}"
        other = seen.setdefault(int(eftrie.tokens(word.encode())[0]) % (1 << 20), word)
        if other != word:
            break
    assert other != word
    rows = [(1, f"{word} red " * 40, "s", False), (2, f"{other} blue " * 40, "s", False), (3, f"{word} blue", "s", True), (4, f"{word} red", "s", True)]
    got = {r.doc_id: r.score for r in eftrie.score_texts(spark.createDataFrame([(k, t, h) for k, t, _, h in rows], "doc_id long, text string, held_out boolean")).collect()}
    want = {int(d): score for d, *_, score in brute(rows)}
    # the numbers by hand for 3: after END (2 texts, one of them starts with word), after word 40 times red, after blue 39 words and 1 end
    p1 = lambda c: (c + 1) / (162 + 5 + 1)
    hand = math.log10((1 + 8 * p1(40)) / (2 + 8)) + math.log10(8 * p1(40) / (40 + 8)) + math.log10((1 + 8 * p1(2)) / (40 + 8))
    assert abs(got[3] - hand) < 1e-3 and all(abs(got[k] - want[k]) < 0.05 for k in got)


def test_the_smoothing_uses_the_exact_number_of_words(spark):
    """More distinct words than any sketch of the smallest hashes holds."""
    check(spark, [(k, " ".join(f"u{k}x{j}" for j in range(500)), "s", k == 3) for k in range(30)])


def test_edges(spark):
    check(spark, [(*r, [None, False, True][k % 3]) for k, r in enumerate(edge_rows())])
    check(spark, [(1, "only held out", "s", True)])
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert eftrie.score_texts(empty).count() == 0


def test_a_chunk_and_a_shard_stay_small(monkeypatch):
    """Peak of numpy's memory per token of a chunk, and per occurrence of a shard (before: 163 and 177 bytes, now 102 and 61)."""
    import tracemalloc

    class Context:
        get = staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())

    def peak(rows):
        tracemalloc.start()
        try:
            return [*rows()], tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    monkeypatch.setattr(eftrie, "TaskContext", Context)
    n, hot = 400_000, np.array([], np.uint64)
    found = (np.random.default_rng(1).integers(1, 60_000, n).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    one = list(range(n // 400)), np.arange(n // 400) % 7 == 2, np.full(n // 400, 400), found
    monkeypatch.setattr(eftrie, "_chunks", lambda batches: iter([one]))
    _, most = peak(lambda: (None for _ in eftrie._sent([], 20, hot)))
    assert most < 130 * n
    packed = [r["packed"][0].as_py() for r in eftrie._sent([], 1, hot) if r["shard"][0].as_py() == 0] * 2
    _, most = peak(lambda: (None for _ in eftrie._shard_scores([0, 1], packed, hot, np.array([], np.int64), 1e8)))
    assert most < 100 * 2 * n
