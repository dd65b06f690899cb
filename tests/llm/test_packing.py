import math
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import crc, documents, edge_rows
from tabwatch.llm import packing
from tabwatch.llm.tokens import encoder, vocabulary

FILE = vocabulary("word_bpe_49k.json")


def check_plan(counts, size):
    used, ranks = defaultdict(list), Counter()
    for length, lo, hi, first, offset in packing.best_fit_plan(counts, size):
        ranks.update((length, r) for r in range(lo, hi + 1))
        for r in range(lo, hi + 1):
            used[first + r - lo].append((offset, length))
    assert ranks == Counter({(length, r): 1 for length, n in counts.items() for r in range(n)})
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(used)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
def test_plans_fit(counts):
    rooms = []  # best fit, one piece at a time
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((40 if fit is None else fit) - length)
    assert check_plan(counts, 40) == len(rooms)


def test_plan_reaches_the_bound_with_many_lengths():
    counts = {k: 3000 // (k + 3) + 1 for k in range(1, 2049)}
    assert check_plan(counts, 2048) <= math.ceil(sum(k * v for k, v in counts.items()) / 2048) * 1.01


def test_documents_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    rows, lib = edge_rows(), encoder(FILE).library
    got = packing.pack_documents(documents(spark, rows), FILE, 64, 0).collect()
    want = []
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(d), k // 64, k, len(ids[k:k + 64]), crc(ids[k:k + 64])) for k in range(0, len(ids), 64)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        ends = [0, *[o + n for o, n in sorted(own)]]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 64


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), FILE, 64, 0).count() == 0


def test_few_texts_are_encoded_at_once(monkeypatch):
    """A large batch is encoded in slices, and gives the pieces that its rows give one by one."""
    import pyarrow as pa

    sizes, real = [], packing.encoder

    class Seen:
        def __init__(self, path):
            self.own = real(path)

        def batch(self, texts):
            sizes.append(len(texts))
            return self.own.batch(texts)

    class Context:
        get = staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})())

    monkeypatch.setattr(packing, "encoder", Seen)
    monkeypatch.setattr(packing, "TaskContext", Context)
    texts = [f"text number {k} of the batch " * (k % 9) for k in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["doc_id", "text"])
    rows = lambda batches: pa.Table.from_batches(packing._pieces(iter(batches), vocabulary("word_bpe_49k.json"), 20, b"\0\0\0\0")).to_pylist()
    whole = rows([batch])
    assert max(sizes) <= 500 and sum(sizes) == 1300
    assert whole == rows([batch.slice(k, 1) for k in range(1300)])
