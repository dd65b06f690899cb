"""Corpus preparation: documents of low quality go, near duplicates go, sources are mixed, the rest is packed.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``. Model scores and tokenizer ids cannot be expressed in SQL, so there is
no ORACLE_SQL; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.llm.classifier import fit, score
from tabwatch.llm.common import remainder, written
from tabwatch.llm.mixing import mix
from tabwatch.llm.packing import pack_documents
from tabwatch.llm.tgm import one_of_each
from tabwatch.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is 0.3 or more.

    The classifier learns from the labels of ``sf_dir`` (those that op2 learns from) and the texts
    at hand. Empty and null texts have the prior's score; without labels of both classes nothing
    is rejected but by the prior.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label")))
    return score(docs, model).where("score >= 0.3").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by a Jaccard similarity of 0.8 or more of five-word sets.

    The one with the smallest doc_id stays. Rows decide, not ids: unrelated rows that share an id all
    stay. Documents with a null id, or without words, are in no group and stay.
    """
    return one_of_each(docs, 5, 80, COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources reach their target weights (5, 2, 1 in turn, at most 3 times)."""
    return mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens: one row a piece."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", deduplicate),
          ("mixing sources", mixed), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
