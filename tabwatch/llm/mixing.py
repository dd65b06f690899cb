"""Mixing sources to target weights: sizes per source, repetition rates, copies of documents.

DataFrame operations only. Sources are ordered by code point (null last) and take the weights in
turn. The mix is as large as all sizes together; a target stops at ``most`` times its source's
size and what is over goes to the other sources by weight, until none is above. The targets are
min(most * size, level * weight); the level is found with one running sum over the sources,
ordered by the level at which each reaches its limit.

A document is taken floor(rate) times, and once more if its draw is below the fraction of the
rate; the draw is the leading 52 bits of md5("seed|doc_id|md5 of the text|number"), the number
counting rows of equal doc_id, source and text from 0, so that every row draws for itself and
reruns agree. Equal rows are counted, not ordered: no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import bounded_broadcast, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Sources (one row each) up to which the table of rates is broadcast.
MOST_SOURCES = 100_000
#: Equal rows that one step writes out.
PIECE = 4096
_SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """Number of words of a text; null is 0. Each word and the space after it becomes one character."""
    no_lead = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A[{_SPACE}]++", "")
    return F.length(F.regexp_replace(no_lead, rf"[^{_SPACE}]++[{_SPACE}]*+", ".")).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate for ``sizes`` (source, size); one row a source.

    A source of size 0 has target and rate 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # partial sums: a hot source is one row a task
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long"))
    limit = F.lit(most) * F.col("source_size")
    filled = limit.cast("double") / F.col("weight")
    order = Window.orderBy(filled, F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    per = (per.withColumn("full", F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("total", F.sum("source_size").over(everything))
           .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open")))
    level = F.max(F.when(F.col("level") <= filled, F.col("level"))).over(everything)
    target = F.least(limit.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return per.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(doc_id: Column, text_hash: Column, number: Column, rate: Column, seed: int = SEED) -> Column:
    """How often a document is taken; a null id draws as the text "null"."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash, number.cast("string"))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def text_md5() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def numbered(df: DataFrame, n: str, first: Column, out: str) -> DataFrame:
    """A row for each of the ``n`` that a row stands for, with their numbers from ``first`` on."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {PIECE}"))))
    inside = F.sequence(F.col("_block") * PIECE, F.least(F.col(n), (F.col("_block") + 1) * PIECE) - 1)
    return blocks.withColumn(out, F.explode(inside)).withColumn(out, F.col(out) + first).drop("_block")


def _rates(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    sizes = docs.select("doc_id", "source", text_md5().alias("hash"), words(F.col("text")).alias("size"))
    sizes = written(sizes.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n")), "mix-sizes")
    rates = written(source_rates(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most), "mix-rates")
    return sizes, bounded_broadcast(rates.withColumnRenamed("source", "_source"), rates.count(), MOST_SOURCES)


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source).

    Null texts have size 0; null is a source of its own, the last; rows that repeat, share an id or
    have none draw one by one; other columns are ignored; an empty table gives no rows.
    """
    sizes, rates = _rates(docs, weights, most)
    rows = numbered(sizes.join(rates, F.col("source").eqNullSafe(F.col("_source"))), "n", F.lit(0), "number")
    taken = F.col("size") * copies(F.col("doc_id"), F.col("hash"), F.col("number"), F.col("rate"), seed)
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it is taken, with all its columns."""
    sizes, rates = _rates(docs, weights, most)
    rates = rates.select("_source", F.col("rate").alias("_rate"))
    names = docs.columns
    again = sizes.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("hash").alias("_of"))
    keyed = docs.withColumn("_hash", text_md5())
    if again.take(1):
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("_hash") == F.col("_of"))
        # rows that are equal in every column are counted; kinds of them (other columns differ) stand in order
        kinds = keyed.join(again, same, "left_semi").groupBy(*names, "_hash").agg(F.count("*").alias("_n"))
        line = Window.partitionBy("doc_id", "source", "_hash").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        several = numbered(kinds.withColumn("_first", F.coalesce(F.sum("_n").over(line), F.lit(0))), "_n", F.col("_first"), "_number")
        keyed = keyed.join(again, same, "left_anti").withColumn("_number", F.lit(0).cast("long")).unionByName(several.drop("_n", "_first"))
    else:
        keyed = keyed.withColumn("_number", F.lit(0).cast("long"))
    times = copies(F.col("doc_id"), F.col("_hash"), F.col("_number"), F.col("_rate"), seed).cast("int")
    taken = keyed.join(rates, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copy", F.explode(F.sequence(F.lit(0), times)))
    return taken.where("_copy > 0").select(*[F.col(f"`{c}`") for c in names])


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS hash, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS number, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight FROM per),
filled AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS fill FROM weighted),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY fill, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY fill, source COLLATE "C" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
rates AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE),
  coalesce(max(CASE WHEN level <= fill THEN level END) OVER (), 0.0) * weight) AS target FROM levels),
drawn AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST(('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || hash || '|' || number), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM drawn
"""
