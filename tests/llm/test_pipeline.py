"""The pipeline's stages on the smallest tables and on awkward rows."""

from __future__ import annotations

import corpus_pipeline as pipeline
from gridloom.llm import minhash, winnowing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "packing"]
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), docs
        if k < 4:
            assert docs.columns == pipeline.COLUMNS and 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            assert minhash.near_duplicates(docs, 5, 80).where("not kept").isEmpty()
        if name == "decontamination":
            assert winnowing.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").isEmpty()
    left = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == left


def test_awkward_rows(spark):
    text = "Some words that stand here for a text in a language of its own, told at length and twice."
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, None, "en", "s", 0), (3, "", "de", "s", 0), (4, "123", None, None, None), (None, text + " More words follow now.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.language(spark, docs, SF)
    assert kept.where("text is null or text in ('', '123')").isEmpty() and kept.count() == 3
    assert pipeline.near_duplicates(spark, kept, SF).where("doc_id = 1").count() == 1
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_stage_rejects_foreign_text_and_noise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    foreign = [
        "Il gatto nero dorme sul tappeto vicino alla finestra mentre fuori piove e la gente torna a casa dopo il lavoro",
        "Kissa istuu pöydällä ja katsoo ulos ikkunasta kun sataa", "Быстрая лиса прыгает через ленивую собаку", "xqzv wkjh ptrrg zzxk qwpl mnbvcx lkjhg",
    ]
    rows = spark.createDataFrame([(-k - 1, t, None, "s", len(t)) for k, t in enumerate(foreign)], docs.schema)
    kept = pipeline.language(spark, docs.union(rows), SF)
    assert kept.where("doc_id < 0").isEmpty()
    good = docs.where("length(text) > 0")
    assert kept.count() >= 0.98 * good.count()


def test_run_rereads_written_stages(spark):
    out = pipeline.run(spark, SF)
    assert out.inputFiles() and all("/packing-" in f for f in out.inputFiles())


def test_language_floor_judges_every_row_held_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gridloom.llm import langid
    from gridloom.llm.common import held_out

    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("the cat sat").alias("text"), F.lit("en").alias("lang"))
    judged = []

    def counted(df, model, known=False):
        judged.append(df.count())
        return df.select(F.lit("en").alias("lang_pred"), F.lit(1.0).alias("known"))

    monkeypatch.setattr(langid, "identify", counted)
    assert langid.fit_with_floor(docs)[1] == 0.5
    assert judged == [docs.where(held_out("doc_id", 8)).count()]


def test_stages_bound_the_texts_of_a_batch(spark):
    docs = spark.createDataFrame([(k, f"some plain words {k}", "en", "s", 20) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        for name, stage in pipeline.STAGES:
            if name != "decontamination":
                spark.conf.set(key, 10_000)
                stage(spark, docs, "")
                assert int(spark.conf.get(key)) == pipeline.BATCH_ROWS <= 1000, name
    finally:
        spark.conf.set(key, usual)
