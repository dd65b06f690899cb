import math

import duckdb
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import documents, edge_rows
from pyspark.sql import functions as F
from tabwatch.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """By rounds: share what is left by weight, stop those above their limit, share again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return {**out, **{s: level * weight[s] for s in open_}}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=9), st.booleans())
def test_targets_are_those_of_the_rounds(spark, sizes, null):
    own = {(None if null and k == 0 else f"s{k}"): n for k, n in enumerate(sizes)}
    df = spark.createDataFrame([(s, n) for s, n in own.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_rates(df).collect()}
    for s, t in targets(own).items():
        assert math.isclose(got[s].target, t, rel_tol=1e-9, abs_tol=1e-9) and 0 <= got[s].rate <= 3


def test_edges_copies_and_words(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    report = mixing.mix_report(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in report) == sorted((str(d), len((t or "").encode().split())) for d, t, _ in rows)
    assert all(r.taken <= 3 * r["size"] for r in report)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.coalesce(F.sum(mixing.words(F.col("text"))), F.lit(0))).first()[0]
    assert words == sum(r.taken for r in report)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix_report(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_sources_come_near_their_targets(spark):
    rows = [(k, "w " * (1 + k % 40), "a" if k % 3 else "b" if k % 9 else "c") for k in range(6000)]
    report = mixing.mix_report(documents(spark, rows, clash=False))
    per = report.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.05 * r.target for r in per)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = sorted(con.execute(mixing.MIX_SQL).fetchall())
    got = mixing.mix_report(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == want


def test_repeated_and_null_ids_draw_one_by_one(spark):
    words = " ".join(["w"] * 5)
    rows = [(None, words, "a")] * 60 + [(None, f"{words} {k}", "a") for k in range(200)] + [(7, words, "b")] * 300 + [(7, f"{words} {k}", "b") for k in range(40)]
    rows += [(1000 + k, words, "c") for k in range(1200)]
    docs = documents(spark, rows)
    per = mixing.mix_report(docs).groupBy("source_size").agg(F.count("*").alias("rows"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert sum(r.rows for r in per) == len(rows) and all(abs(r.taken - r.target) <= 0.12 * r.target for r in per)
    taken = sorted(r.taken for r in mixing.mix_report(docs).collect())
    assert taken == sorted(r.taken for r in mixing.mix_report(docs.repartition(7)).collect())
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken)


def test_sql_of_repeated_rows(spark):
    import pandas as pd
    rows = [(None, "a b", "x"), (None, "a b", "x"), (1, "a b c", "y"), (1, "a b c", "y"), (1, "a", "y"), (2, None, None), (2, "", None)] * 9
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    got = mixing.mix_report(documents(spark, rows)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(str, con.execute(mixing.MIX_SQL).fetchall())) == sorted(map(str, map(tuple, got.collect())))
