import pytest

from helpers import documents, edge_rows
from tabwatch.llm.counts import count_tokens
from tabwatch.llm.tokens import encoder, vocabulary

FILE = vocabulary("byte_bpe_50k.json")


def brute(rows):
    lib = encoder(FILE).library
    return sorted((d is not None, d or 0, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 30)
                  for d, t, _ in rows)


def told(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (100, 60), (40, 39)])
def test_counts_are_those_of_whole_texts(spark, chunk, overlap):
    rows = edge_rows() + [(30, "spaces" + " " * 900 + "end " * 80, "s"), (31, "a<|endoftext|>b c " * 60, "s"), (31, "a<|endoftext|>b c " * 60, "s"),
                          (32, "日本 " * 300, "s"), (33, "\n \n  \n" * 200, "s"), (34, "oneword" * 300, "s")]
    assert told(count_tokens(documents(spark, rows), FILE, 30, chunk, overlap)) == brute(rows)


def test_other_vocabulary_and_empty_table(spark):
    rows = [(1, "a few words", "s"), (2, None, "s")]
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(spark, rows), vocabulary("piece_bpe_32k.model"), 1024).collect()}
    assert got[1] > 0 and got[2] == 0
    assert count_tokens(documents(spark, []), FILE, 1024).count() == 0


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        count_tokens(documents(spark, []), FILE, 1, 10, 10)
