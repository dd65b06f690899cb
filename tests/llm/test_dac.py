import numpy as np

from helpers import crc, documents, edge_rows
from tabwatch.llm import dac
from tabwatch.llm.common import scratch_path
from tabwatch.llm.tokens import encoder, vocabulary

FILE = vocabulary("byte_bpe_50k.json")


def test_levels_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 511, 512, 513, 5000):
        ids = rng.integers(0, [1, 300, 70_000, 2 ** 32][n % 4], n, dtype=np.uint64)
        ids[:: 7] = 5
        seg = dac.Segment(*dac.pack(ids))
        assert seg.tokens(0, n).tolist() == ids.tolist()
        for _ in range(20):
            i = int(rng.integers(0, n))
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert seg.token(i) == ids[i] and seg.tokens(lo, hi).tolist() == ids[lo:hi].tolist()
            assert seg.rank(0, i) == int((ids[:i] >= 256).sum())


def test_files_hold_whole_documents_in_order(spark):
    rows, folder = edge_rows(), scratch_path(spark, "test-dac")
    dac.write_tokens(documents(spark, rows), folder, FILE, 2, segment_tokens=300)
    got = dac.read_documents(spark, folder).collect()
    enc = encoder(FILE).library
    want = sorted((d is not None, d or 0, crc(ids := enc.encode(t or "", add_special_tokens=False).ids + [2]), len(ids)) for d, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert ids == sorted(ids)


def test_a_range_of_tokens_is_read_alone(spark):
    folder = scratch_path(spark, "test-dac")
    texts = {k: f"document {k} says {k * k} things" for k in range(50)}
    dac.write_tokens(documents(spark, [(k, t, "s") for k, t in texts.items()]), folder, FILE, 2, segment_tokens=40)
    every = [x for t in texts.values() for x in encoder(FILE).library.encode(t, add_special_tokens=False).ids + [2]]
    for lo, n in ((0, 5), (17, 200), (len(every) - 3, 3)):
        assert dac.read_range(spark, folder, lo, n) == every[lo:lo + n]


def test_empty_table(spark):
    folder = scratch_path(spark, "test-dac")
    dac.write_tokens(documents(spark, []), folder, FILE, 2)
    assert dac.read_documents(spark, folder).count() == 0
