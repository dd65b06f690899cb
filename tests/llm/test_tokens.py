import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import EDGE_TEXTS
from tabwatch.llm.tokens import Encoder, encoder, vocabulary

ALPHABET = "ab'sStT re ve09 ²½  \n\n\t\r!?-_éÉß’“—€İ́<|endoftext|>x日🙂\x0b\x1c\u0085"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    enc, rng = encoder(vocabulary(name)), random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice("abSéÉ9!' ") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [t or "" for t in EDGE_TEXTS]
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == want
    assert [x.tolist() for x in enc.batch(pa.array([t.encode() for t in texts], pa.binary()))] == want


def test_boundaries_count_the_ids_before():
    enc = encoder(vocabulary("byte_bpe_50k.json"))
    for text in ("plain words, and 12 more", "odd 日本 text", ""):
        at, before = enc.boundaries(text)
        for p, n in zip(at.tolist(), before.tolist()):
            assert len(enc.library.encode(text[:p], add_special_tokens=False).ids) == n


def test_each_distinct_string_of_a_batch_is_asked_for_once(monkeypatch):
    """The strings that Arrow tells apart reach the cache as Python strings, each once, in any alphabet."""
    enc = encoder(vocabulary("byte_bpe_50k.json"))
    texts = ["", "a", "naïve café naïve", "two two words", "tab\there", "été 12 été"]
    asked = []

    class Seen(dict):
        def __missing__(self, x):
            asked.append(x)
            return enc._chunk(x)

    monkeypatch.setattr(enc, "chunks", Seen())
    got = enc.batch(pa.array([t.encode() for t in texts], pa.binary()))
    assert [x.tolist() for x in got] == [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(type(x) is str for x in asked) and "naïve" in asked


def test_a_word_is_kept_once_and_forgotten():
    """Of the lower-casing vocabulary: what stands alone and next to a comma is one entry (before: in both caches)."""
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    own = enc.batch(pa.array([b"Some words, and some other words"], pa.binary()))[0].tolist()
    assert own == enc.library.encode("Some words, and some other words", add_special_tokens=False).ids
    assert sorted(enc.chunks) == sorted(["some", "words,", "words", ",", "and", "other"]) and not enc.pieces
    enc.forget()
    assert not enc.chunks and not enc.chunks.older
