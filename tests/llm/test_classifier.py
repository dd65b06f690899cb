import numpy as np
from conftest import SF_MID
from helpers import documents, edge_rows
from pyspark.sql import functions as F
from tabwatch.llm import classifier
from tabwatch.llm.common import remainder


def test_held_out_labels_are_found(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label")))
    rows = classifier.score(docs, model).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).select("score", "quality").collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) >= 0.95


def test_scores_do_not_depend_on_batches_or_caches():
    rng = np.random.default_rng(1)
    model = classifier.Model(rng.normal(size=classifier.BUCKETS), 0.3)
    texts = [b"", b"a a a b", b"x" * 300 + b" y y " + b"x" * 300, "é é ÉÉ".encode(), b"one two " * 50]
    for text, got in zip(texts, classifier.scores(texts, model)):
        own, n = classifier.text_buckets(text)
        z = 0.3 + ((model.weights[own] * n).sum() / n.sum() if len(own) else 0)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
        assert classifier.scores([text], model)[0] == got


def test_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (7, None), (99, 1), (20, 1)], "doc_id long, label int")
    docs = documents(spark, edge_rows())
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == len(edge_rows())
    empty = {r.score for r in rows if not (r.text or "").strip(" \n\t")}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in rows)


def test_without_labels_every_text_has_the_prior(spark):
    docs = documents(spark, edge_rows())
    model = classifier.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score for r in classifier.score(docs, model).collect()} == {0.5}
    assert classifier.score(documents(spark, []), model).count() == 0


def test_the_sample_is_bounded(spark):
    docs = documents(spark, [(k, f"text {k} " + ("bad!! bad!!" if k % 2 else "fine words"), "s") for k in range(60)])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, label int")
    model = classifier.fit(docs, labels, most_per_class=10)
    rows = classifier.score(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows)


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "learn", lambda examples, odds: seen.append(examples) or classifier.Model(np.zeros(classifier.BUCKETS), odds))
    rows = [(1, f"text number {k}", "s") for k in range(300)] + [(1, "text number 1", "s")] * 50 + [(k, "other", "s") for k in range(2, 9)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, label int")
    classifier.fit(documents(spark, rows), labels, most_per_class=20)
    assert [sum(label == k for label, _, _ in seen[0]) for k in (0, 1)] == [3, 20]
