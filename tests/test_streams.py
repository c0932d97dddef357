"""A scoring query that is stopped after its first batch goes on from its checkpoint."""

import time

from pyspark.sql import functions as F

from mojiframe.operators import models as ML
from mojiframe.streaming import scoring_stream as ST


def test_stopped_and_restarted(spark, tmp_path):
    path = str(tmp_path / "model")
    ML.save_model(ML.bag_of_words_model(spark, {"good": 1.0, "bad": -1.0}, 0.1), path)
    rows = spark.range(600).select("id", F.when(F.col("id") % 2 == 0, "good good").otherwise("bad").alias("text"))
    rows.repartition(12).write.parquet(str(tmp_path / "in"))

    def start(once):
        stream = ST.row_stream(spark, str(tmp_path / "in"), "id long, text string", max_files=1)
        return ST.start_scoring(ST.score_stream(ML.load_model(path), stream, "r"), str(tmp_path / "out"), str(tmp_path / "ckpt"), once)

    q = start(once=False)
    while not (tmp_path / "ckpt/commits/0").exists():
        time.sleep(0.02)
    q.stop()
    committed = len(list((tmp_path / "ckpt/commits").glob("[0-9]*")))
    assert 1 <= committed < 12
    start(once=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 600 == out.select("id").distinct().count()
    assert {(r.y_pred, round(r.p, 6)) for r in out.where("id % 2 = 0").collect()} == {(1, 0.890903)}
    assert out.where("id % 2 = 1 and y_pred = 0").count() == 300


def test_documents_in_a_folder_of_parts(spark, tmp_path):
    """A table may be one file or a folder of files with any names."""
    from mojiframe.streaming.variants_stream import document_stream, start_to_parquet, variants_stream

    rows = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(4).write.parquet(str(tmp_path / "many/documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "staged"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "staged").glob("part-*.parquet")).rename(tmp_path / "one/documents.parquet")
    for form in ("many", "one"):
        v = variants_stream(document_stream(spark, str(tmp_path / form)))
        start_to_parquet(v, str(tmp_path / f"{form}-out"), str(tmp_path / f"{form}-ckpt")).awaitTermination()
        out = spark.read.schema(v.schema).parquet(str(tmp_path / f"{form}-out"))
        assert sorted((r.id, r.x_text) for r in out.collect()) == [(i, f"text {i}") for i in range(40)]
