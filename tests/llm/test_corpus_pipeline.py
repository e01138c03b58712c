"""The pipeline's stages, each on its predecessor's rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_llm_exact import WORD, documents, labels, words


def test_stages_decide(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    items = [words(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 8]) for w in items for i in range(max(1, len(w) - 7))}
    docs, kept = source, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == source.columns and docs.join(before, "doc_id", "left_anti").isEmpty()
    toxic = marks.filter("toxic = 1").count()
    assert kept["toxicity"].join(marks.filter("toxic = 1"), "doc_id").count() < 0.5 * toxic  # few examples at this size
    assert kept["toxicity"].join(marks.filter("toxic = 0"), "doc_id").count() > 0.97 * marks.filter("toxic = 0").count()
    assert kept["line dedup"].count() == kept["toxicity"].count()
    assert kept["line dedup"].filter(F.length("text") != F.col("n_chars")).count() == kept["toxicity"].filter(F.length("text") != F.col("n_chars")).count()
    clean = kept["decontamination"].collect()
    for r in clean:
        w = words(r.text)
        assert not any(tuple(w[i : i + 8]) in windows for i in range(len(w) - 7))
    assert {r.doc_id for r in kept["packing"].select("doc_id").distinct().collect()} == {r.doc_id for r in clean}
    assert WORD


def test_stages_take_odd_and_empty_rows(spark, tmp_path):
    labels(spark, [(5, 1, 1), (6, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("1", "the of and")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark), documents(spark).filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).count()


def test_rows_pass_through_whole(spark):
    from tessera.llm.decontaminate import decontaminate
    from tessera.llm.toxicity import toxicity_scores

    docs = documents(spark)
    bench = spark.createDataFrame([("1", "the of and")], "item_id string, text string")
    known = labels(spark, [(i, 1, i % 2) for i in range(10, 60)])
    for frame in (decontaminate(docs, bench, whole=True), toxicity_scores(docs, known, whole=True), toxicity_scores(docs, labels(spark), whole=True)):
        assert frame.select("document.*").exceptAll(docs).isEmpty() and frame.count() == docs.count()
