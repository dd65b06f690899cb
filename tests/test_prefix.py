"""The bucketed prefix-sum path equals the plain window path."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from tabwatch.functions.reshape import to_long
from tabwatch.operators.prefix import exact_quantiles, positions, running_totals, value_counts_long

COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def test_bucketed_equals_plain(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    counts = value_counts_long(to_long(li, COLS), ["feature"], "value")
    plain = running_totals(counts, ["feature"], "value", ["_n"], buckets=1)
    bucketed = running_totals(counts, ["feature"], "value", ["_n"], buckets=24)
    assert plain.exceptAll(bucketed).count() == 0 and bucketed.exceptAll(plain).count() == 0


def test_descending_positions(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    a = positions(df, ["g"], "v", descending=True, buckets=1)
    b = positions(df, ["g"], "v", descending=True, buckets=7)
    assert a.exceptAll(b).count() == 0
    assert b.where("v = 100").collect()[0].pos == 1


@pytest.mark.parametrize("buckets", [1, 5])
def test_quantiles_match_duckdb(spark, buckets):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    got = {(r.feature, r.p): r.q for r in exact_quantiles(to_long(li, COLS), ["feature"], "value",
                                                          [0.0, 0.1, 0.5, 0.9, 1.0], buckets=buckets).collect()}
    con = duckdb.connect()
    for c in COLS:
        for p in [0.0, 0.1, 0.5, 0.9, 1.0]:
            want = con.execute(f"SELECT quantile_cont({c}, {p}) FROM '{SF_MID}/lineitem.parquet'").fetchone()[0]
            assert got[(c, p)] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_binary_search_buckets_equal_plain(spark):
    """Many buckets give the same sums as one."""
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    counts = value_counts_long(to_long(li, ["l_extendedprice"]), ["feature"], "value")
    plain = running_totals(counts, ["feature"], "value", ["_n"], buckets=1)
    many = running_totals(counts, ["feature"], "value", ["_n"], buckets=300)
    assert plain.exceptAll(many).count() == 0 and many.exceptAll(plain).count() == 0


def test_edge_index_counts_the_edges_below(spark):
    from tabwatch.operators.prefix import _edge_index_bsearch
    edges = [float(x) for x in range(0, 200, 2)]
    df = spark.range(-5, 210).select((F.col("id") * 1.0).alias("v"), F.array(*[F.lit(e) for e in edges]).alias("e"))
    got = df.select(F.size(F.filter("e", lambda e: e < F.col("v"))).alias("a"),
                    _edge_index_bsearch(F.col("e"), F.col("v"), len(edges)).alias("b"))
    assert got.where("a != b").count() == 0


def test_lead_across_buckets(spark):
    df = spark.range(0, 500).select(F.lit(1).alias("g"), (F.col("id") * 1.0).alias("v"), F.col("id").alias("x"))
    for desc in (False, True):
        a = running_totals(df, ["g"], "v", ["x"], descending=desc, buckets=1, lead=["x"])
        b = running_totals(df, ["g"], "v", ["x"], descending=desc, buckets=9, lead=["x"])
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("max_groups", [None, 3])
def test_fixed_edges_paths_agree(spark, max_groups):
    """Broadcast edges (bounded groups) and checkpointed edges give the plain-window result."""
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    counts = value_counts_long(to_long(li, COLS), ["feature"], "value")
    plain = running_totals(counts, ["feature"], "value", ["_n"], buckets=1)
    cut = running_totals(counts, ["feature"], "value", ["_n"], buckets=6, max_groups=max_groups)
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0
