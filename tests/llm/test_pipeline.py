import corpus_pipeline as P
from conftest import SF_SMALL
from tabwatch.llm.common import written


def test_stages_keep_the_columns_and_whole_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(written(stage(spark, seen[-1], SF_SMALL), "test-pipeline"))
    before, good, single, mixed, packed = seen
    rows = {r.doc_id: r for r in before.collect()}
    for df in (good, single, mixed):
        assert df.columns == before.columns and all(rows[r.doc_id] == r for r in df.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    wrong = [d for d, q in labels.items() if d in rows and (d in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    assert single.count() == single.select("doc_id").distinct().count() <= good.count()
    assert sorted(r.doc_id for r in packed.where("piece = 0").collect()) == sorted(r.doc_id for r in mixed.collect())


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"word{k}" for k in range(100))
    rows = [(1, base), (2, base + " more"), (2, base + " more"), (3, "another text that stands alone here"), (None, base), (None, None),
            (4, None), (5, ""), (6, base.upper()), (3, "another text that stands alone here")]
    docs = spark.createDataFrame([(d, t, "en", "s", None, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n string")
    got = P.deduplicate(spark, docs, SF_SMALL)
    assert got.columns == P.COLUMNS
    assert sorted(str((r.doc_id, r.text is None)) for r in got.collect()) == sorted(
        str(x) for x in ((1, False), (3, False), (None, False), (None, True), (4, True), (5, False)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0
