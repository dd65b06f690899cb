"""The registered queries themselves: columns, remainders and limits of their contracts."""

import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from tokenizers import Tokenizer

import public_tokenizers
from corpus_pipeline import run
from helpers import crc
from tabwatch.llm.queries import ORACLE, QUERIES

COLUMNS = {1: "doc_id start n_tokens ids_crc32", 2: "doc_id held_out score predicted", 3: "doc_id n_bytes n_tokens over_limit", 4: "conv_id message",
           5: "vec_id n_links component_id kept", 6: "query_id rank vec_id score", 7: "doc_id piece start length ids_crc32 sequence_id offset",
           8: "doc_id n_shingles component_id", 9: "doc_id held_out n_tokens n_known train_tokens base_score score",
           10: "doc_id size source_size target taken", 11: "item_id rank doc_id score",
           12: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", 13: "doc_id n_words n_removed kept_sha256"}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, q in QUERIES.items():
        df = q(spark, SF_SMALL)
        out[int(name[2:].split("_")[0])] = (df.columns, df.collect())
    return out


def remainder(x, n):
    return zlib.crc32(str(x).encode()) % n


def test_columns_and_rows(results, texts):
    assert sorted(results) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
    for n, (columns, rows) in results.items():
        assert set(COLUMNS[n].split()) <= set(columns) and rows
        if columns[0] == "doc_id" and n != 7:
            assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_tokens(results, texts):
    bpe = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d: bpe.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    at = 0
    for r in sorted(results[1][1], key=lambda r: r.doc_id):
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), crc(own))
        at += len(own)
    for r in results[3][1]:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 1024)


def test_packing(results, texts):
    bpe = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    by, used = {}, {}
    for r in results[7][1]:
        by.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in texts.items():
        own = [*bpe.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted(by[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [
            (k, k * 2048, len(own[k * 2048:(k + 1) * 2048]), crc(own[k * 2048:(k + 1) * 2048])) for k in range(-(-len(own) // 2048))]
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 2048


def test_folds_and_scores(results, texts):
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in results[2][1])
    split = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    counts, total = {}, 0
    for d, words in split.items():
        if remainder(d, 7) != 2:
            total += len(words)
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    for r in results[9][1]:
        own = split[r.doc_id]
        base = sum(np.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(own), total)
        assert r.n_known == sum(w in counts for w in own) and r.base_score == pytest.approx(base)


def test_vectors(results):
    assert {r.query_id % 50 for r in results[6][1]} == {0} and max(r["rank"] for r in results[6][1]) == 5
    assert max(r["rank"] for r in results[11][1]) <= 50


def test_pipeline(spark, texts):
    rows = run(spark, SF_SMALL).collect()
    assert rows and {r.doc_id for r in rows} <= set(texts) and max(r.offset + r.length for r in rows) <= 2048
