import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import documents, edge_rows, prose
from tabwatch.llm import superkmer


def told(df):
    out = df.withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.sha)) for r in out)


def brute(rows, n):
    found = superkmer.kept_by_brute_force([t for _, t, _ in rows], n)
    return sorted(str((d, *x)) for (d, _, _), x in zip(rows, found))


def corpus(seed, n):
    """Unrelated texts, copies with edits, a passage and a short line that many share, a looping text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    passage, line = prose(rng, 60, words), prose(rng, 12, words)
    rows = [(0, " ".join([prose(rng, 7, words)] * 60), "a"), (1, "the same " * 400, "a")]
    for i in range(2, n):
        text = prose(rng, rng.choice([3, 30, 34, 35, 36, 90, 300]), words)
        if rng.random() < 0.3:
            text = f"{text}\n{passage}  {prose(rng, 20, words)}"
        if rng.random() < 0.5:
            text = f"{line} {text} \t{line}"
        if rng.random() < 0.2:
            text = " ".join(w if rng.random() > 0.02 else "edited" for w in rows[rng.randrange(len(rows))][1].split(" "))
        rows.append((i, text, "a"))
    return rows


@pytest.mark.parametrize("n", [1, 3, 35])
def test_against_brute_force(spark, n):
    rows = corpus(n, 120)
    assert told(superkmer.remove_repeats(documents(spark, rows).repartition(5), n)) == brute(rows, n)


def test_hot_minimisers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "LEAST_HOT", 3)
    monkeypatch.setattr(superkmer, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(superkmer, "MOST_WINDOWS", 5)
    monkeypatch.setattr(superkmer, "REMEMBERED", 10)
    rows = corpus(9, 100)
    assert told(superkmer.remove_repeats(documents(spark, rows).repartition(3), 35)) == brute(rows, 35)


def test_odd_rows(spark):
    rows = edge_rows()
    assert told(superkmer.remove_repeats(documents(spark, rows), 35)) == brute(rows, 35)
    assert superkmer.remove_repeats(documents(spark, []), 35).count() == 0


def test_spans_are_the_removed_words(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    rows = [(1, f"a b {passage} c", "s"), (2, passage, "s"), (3, f"{passage} x", "s"), (4, "y " + passage[3:], "s")]
    got = {r.doc_id: r for r in superkmer.remove_repeats(documents(spark, rows), 35).collect()}
    assert [(s.begin, s.end) for s in got[1].spans] == [(2, 37)] and got[1].kept == "a b c"
    assert got[2].kept == "" and got[3].kept == "x" and got[4].n_removed == 0 and got[4].spans == []


def test_colliding_hashes(monkeypatch):
    monkeypatch.setattr(superkmer, "_mix", lambda x, seed=0: x * np.uint64(0))
    strings = [b"a b c d", b"b c x", b"z y x", b"q q q q"]
    flags = superkmer.repeated(strings, np.zeros(4, bool), 2)
    assert [f.tolist() for f in flags] == [[False, True, False], [True, False], [False, False], [True, True, True]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=8), st.integers(1, 12))
def test_super_kmers_hold_every_window_once(texts, n):
    raw = [" ".join(t).encode() for t in texts]
    s = superkmer.Strings(raw, n, np.zeros(0, np.uint64))
    got = Counter()
    for i in range(len(s.doc)):
        words = s.packed(i).split()
        assert len(words) == s.words[i]
        for j in range(len(words) - n + 1):
            got[int(s.doc[i]), int(s.first[i]) + j, tuple(words[j:j + n])] += 1
    want = Counter((d, j, tuple(x.encode() for x in t[j:j + n])) for d, t in enumerate(texts) for j in range(len(t) - n + 1))
    assert got == want
