import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, edge_rows, prose
from tabwatch.llm import tgm


def brute(rows, k, percent):
    sets = []
    for d, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = sorted({r[0] for r in rows if r[0] is not None})
    comp = {i: i for i in ids}
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in ids:
        before = dict(comp)
        for a, b in links:
            comp[rows[a][0]] = comp[rows[b][0]] = min(comp[rows[a][0]], comp[rows[b][0]])
        if comp == before:
            break
    return sorted(str((d, len(s), comp.get(d))) for (d, _, _), s in zip(rows, sets))


def told(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def corpus(seed, n):
    """Unrelated texts, families of edited copies, and a passage and a line that many share."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    passage, line = prose(rng, 60, words), prose(rng, 12, words)
    rows = []
    for _ in range(n):
        text = prose(rng, rng.choice([3, 5, 20, 80, 200]), words).split()
        for _ in range(rng.choice([1, 1, 1, 2, 12])):
            own = list(text)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(words)
            extra = rng.choice(["", "", " " + passage, "\n" + line])
            rows.append((len(rows) * 7 % 10_007, " ".join(own) + extra, "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_components_are_those_of_all_pairs(spark, k, percent):
    rows = corpus(k, 120)
    assert told(tgm.jaccard_components(documents(spark, rows), k, percent)) == brute(rows, k, percent)


def test_cut_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(tgm, "PART_TOKENS", 300)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    text = prose(rng, 150, words).split()
    rows = [(k, " ".join(w if rng.random() > 0.01 else rng.choice(words) for w in text), "s") for k in range(80)]
    assert told(tgm.jaccard_components(documents(spark, rows), 4, 85)) == brute(rows, 4, 85)


def test_edges(spark):
    rows = edge_rows()
    assert told(tgm.jaccard_components(documents(spark, rows), 4, 85)) == brute(rows, 4, 85)
    assert tgm.jaccard_components(documents(spark, []), 4, 85).count() == 0


def test_prefixes_of_linked_sets_share_enough_tokens():
    rng = np.random.default_rng(3)
    crowded = rng.random(1 << tgm.SKETCH_BITS) < 0.1
    for _ in range(400):
        n, percent = int(rng.integers(1, 300)), int(rng.choice([50, 80, 85, 95]))
        pool = np.unique(rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, min(len(pool), max(1, n - int(rng.integers(0, n // 6 + 1)))), replace=False)) for _ in range(2))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.85, 1))], b[: n // 40]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        small, large = sorted((a, b), key=len)
        tokens, short = tgm.prefix(small, crowded, percent)
        assert len(np.intersect1d(tokens[:short], tgm.prefix(large, crowded, percent)[0])) >= tgm.extra(len(small))


def test_shared_ids_join_components(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (9, b, "s"), (9, None, "s"), (12, c, "s"), (12, "", "s"), (4, c, "s"), (20, "", "s")]
    got = told(tgm.jaccard_components(documents(spark, rows), 4, 85))
    assert got == brute(rows, 4, 85)
    assert {x.split(", ")[0]: x.split(", ")[2] for x in got} == {"(3": "3)", "(5": "3)", "(9": "3)", "(12": "4)", "(4": "4)", "(20": "20)"}


def test_many_near_copies_meet_as_a_group(spark):
    """200 copies of one text, each with its own edits: the last join sees groups, not pairs of copies."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    text = prose(rng, 120, words).split()
    rows = [(k, " ".join(w if rng.random() > 0.008 else rng.choice(words) for w in text), "s") for k in range(200)]
    docs = documents(spark, rows)
    assert told(tgm.jaccard_components(docs, 4, 85)) == brute(rows, 4, 85)


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, "quite another text"), (8, None), (8, "here are words"), (8, None), (9, a + " more"), (None, a), (5, b)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    got = tgm.one_of_each(docs, 4, 85, ["doc_id", "text"]).collect()
    want = [(3, a), (5, b), (7, c), (7, "quite another text"), (8, None), (8, "here are words"), (8, None), (None, a)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_an_index_of_members_stays_small():
    """Peak of numpy's memory per token of an index of sets (before: 40 bytes, now 24)."""
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64)) for _ in range(100)]
    tracemalloc.start()
    try:
        index = tgm._Members(sets)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 36 * sum(map(len, sets))
    assert index.near(sets[7], 85).tolist() == [7]


def test_a_passage_of_many_texts_pairs_none_of_them(spark, monkeypatch):
    """Each twelve of 60 unrelated texts share a passage: its tokens come last in the prefixes, so the joins
    on tokens see none of it (before: every two of the twelve)."""
    rng = random.Random(6)
    passage = lambda d: [f"p{d // 12}x{k}" for k in range(60)]
    rows = [(d, " ".join([f"w{d}x{k}" for k in range(60)] + passage(d) + [f"v{d // 2}x{k}" for k in range(30)]), "s") for d in range(60)]
    rows += [(100 + d, rows[d][1] + " end" * rng.randint(1, 2), "s") for d in range(5)]
    seen, write = {}, tgm.written
    monkeypatch.setattr(tgm, "written", lambda df, name: seen.setdefault(name, []).append(write(df, name)) or seen[name][-1])
    assert told(tgm.jaccard_components(documents(spark, rows), 4, 85)) == brute(rows, 4, 85)
    assert [df.groupBy("token").count().where("count > 2").count() for df in seen["tgm-matrix"]] == [0, 0]


@pytest.mark.parametrize("vocabulary", [5000, 100])
def test_variants_of_a_text_do_not_pair_each_other(spark, monkeypatch, vocabulary):
    """200 texts with three or four words of one text changed, too many to be linked with it: the joins on
    tokens don't pair every two of them (before: 200 times 200 rows for each of five tokens at the end)."""
    rng = random.Random(11)
    text = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(text), "s")]
    for d in range(1, 201):
        own = list(text)
        for at in rng.sample(range(4, 146, 5), rng.choice([3, 4])):
            own[at] = f"v{rng.randrange(vocabulary)}"
        rows.append((d, " ".join(own), "s"))
    rows += [(300 + d, rows[d][1] + " end", "s") for d in range(1, 6)]
    seen, write = {}, tgm.written
    monkeypatch.setattr(tgm, "written", lambda df, name: seen.setdefault(name, []).append(write(df, name)) or seen[name][-1])
    assert told(tgm.jaccard_components(documents(spark, rows), 4, 85)) == brute(rows, 4, 85)
    held = seen["tgm-matrix"][-1].groupBy("token").agg(F.count("*").alias("all"), F.count("least_indexed").alias("indexed"))
    assert held.agg(F.sum(F.col("all") * F.col("indexed"))).first()[0] < 40 * len(rows)
    assert seen["tgm-pairs"][-1].count() < 10 * len(rows)


def test_the_one_token_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    crowded = np.zeros(1 << tgm.SKETCH_BITS, bool)
    crowded[rng.integers(0, len(crowded), len(crowded) // 3)] = True
    heavy = tuple(rng.integers(0, 256, 1 << (tgm.FILTER_BITS - 3), np.uint8) for _ in tgm.HEAVY)
    for _ in range(300):
        percent, n = int(rng.choice([50, 80, 85])), int(rng.integers(1, 300))
        small = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        large = np.unique(np.concatenate([small[int(rng.integers(0, 1 + n // 12)):], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 4))).astype(np.uint64)]))
        both = len(np.intersect1d(small, large))
        if 100 * both < percent * (len(small) + len(large) - both):
            continue
        small, large = sorted((small, large), key=len)
        rows = [tgm._prefixes([(1, s)], crowded, percent, heavy).to_pydict() for s in (small, large)]
        own = [{t for t, first in zip(r["token"], r["first"]) if first >= least} for r, least in zip(rows, (2, 1))]
        assert own[0] & own[1]
