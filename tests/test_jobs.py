"""Composed jobs: preparation run (C11) end to end on sf0.001."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabwatch.plans.jobs import run_preparation
from tabwatch.session import scratch_path
from tabwatch.sources import files as A

RAW = ["Order Key", "Quantity", "Extended Price", "Discount", "Tax", "Line Number"]
FEATS = ["Quantity", "Extended Price", "Discount", "Tax"]


def test_run_preparation(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = [F.col(c).cast("string").alias(n) for c, n in zip(
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], RAW)]
    base = scratch_path(spark, "test-prep")
    A.write_delimited(li.where(F.col("l_returnflag") == "R").select(*cols), f"{base}/a")
    A.write_delimited(li.where(F.col("l_returnflag") != "R").select(*cols), f"{base}/b")
    res = run_preparation(spark, [(f"{base}/a", "a"), (f"{base}/b", "b")], RAW, FEATS, "Line Number",
                          scratch_path(spark, "test-prep-out"))
    labelled = li.where((F.col("l_linenumber") <= 5) | (F.col("l_linenumber") >= 6)).count()
    sizes = {r.split: r["count"] for r in res.prepared.groupBy("split").count().collect()}
    assert set(sizes) == {"train", "validation", "test"} and sum(sizes.values()) <= labelled
    params = {r.feature: r for r in res.params.collect()}
    assert set(params) == {"quantity", "extended_price", "discount", "tax"}
    assert all(p.scale > 0 and p.lower <= p.upper for p in params.values())
    train = res.prepared.where("split = 'train'")
    means = train.agg(*[F.avg(c).alias(c) for c in params]).collect()[0]
    assert all(abs(means[c]) < 0.5 for c in params)      # standardised on train (after clipping)
    sections = {r.section for r in res.report.collect()}
    assert {"deduplication", "null_counts", "label_distribution_full", "shape_rows"} <= sections


def test_run_preparation_reads_its_sources_once(spark, monkeypatch, tmp_path):
    """The deduplication and its report share one grouping of the sources; copies and null cells count."""
    from tabwatch.operators import clean as B

    lines = ["Order Key;Quantity;Extended Price;Discount;Tax;Line Number"] + [f"{k};{k % 9};{k * 3};0.1;{'' if k % 4 else 0.2};{1 + k % 7}" for k in range(60)]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines + lines[1:11]) + "\n")
    made, grouped = [], B.drop_exact_duplicates
    monkeypatch.setattr(B, "drop_exact_duplicates", lambda df, **kw: made.append(kw) or grouped(df, **kw))
    res = run_preparation(spark, [(str(path), "a")], RAW, FEATS, "Line Number", str(tmp_path / "out"))
    told = {(r.section, r.key): r.value for r in res.report.collect()}
    assert [told["deduplication", k] for k in ("rows_before_deduplication", "rows_after_deduplication", "duplicates_removed")] == [70.0, 60.0, 10.0]
    assert told["null_counts", "tax"] == 45.0 and ("null_counts", "_copies") not in told
    assert made == [{"copies": "_copies"}] and res.prepared.count() == 60
