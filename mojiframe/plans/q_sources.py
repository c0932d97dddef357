"""Registered source/sink and streaming queries (S1-S3, K1, S6/K3, streaming).

Each writes derived data of the given tables to the shared checkpoint folder
and reads it back, so the check covers the reader/writer options on whole
texts (quotes, newlines, Unicode)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mojiframe.plans import sqltext as S
from mojiframe.plans.catalog import register
from mojiframe.session import checkpoint_dir
from mojiframe.sources import io as IO
from mojiframe.sources import tables as T


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s01_csv_roundtrip", lambda: (
    f"SELECT text AS tweet, label AS sarcastic, rephrase FROM ({S.corpus_sql()})"))
def s01_csv_roundtrip(spark, sf):
    """K1 + S1/S3: the corpus as a training CSV (with a stray index column,
    multi-line quoted text) written and read back with the toolkit's reader."""
    path = _scratch(spark, "train_csv")
    c = T.corpus(spark, sf).select(F.col("id").alias("_c0"), F.col("text").alias("tweet"),
                                   F.col("label").alias("sarcastic"), "rephrase")
    IO.write_variants(c, path, fmt="csv")
    return IO.read_labelled_csv(spark, path, IO.TRAIN_SCHEMA)


@register("p04_row_ids", lambda: (
    f"SELECT row_number() OVER (ORDER BY part, id) - 1 AS id, text AS tweet, label AS sarcastic, rephrase FROM "
    f"(SELECT *, CASE WHEN id % 10 = 0 THEN 0 WHEN id % 10 < 3 THEN 1 ELSE 2 END AS part FROM ({S.corpus_sql()}))"))
def p04_row_ids(spark, sf):
    """Row ids in file order over CSV files of uneven size in three folders."""
    path = _scratch(spark, "csv_files")
    part = F.when(F.col("id") % 10 == 0, 0).when(F.col("id") % 10 < 3, 1).otherwise(2)
    c = T.corpus(spark, sf).select("id", F.col("text").alias("tweet"), F.col("label").alias("sarcastic"), "rephrase", part.cast("int").alias("part"))
    c = c.repartitionByRange("part", "id").sortWithinPartitions("part", "id").withColumnRenamed("id", "_c0")
    c.write.partitionBy("part").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return IO.read_labelled_csv(spark, path, IO.TRAIN_SCHEMA, "id").select("id", "tweet", "sarcastic", "rephrase")


@register("s06_predictions_roundtrip",
          lambda: f"WITH {S.preds_cte()} SELECT run, id, y_true, y_pred, p FROM preds")
def s06_predictions_roundtrip(spark, sf):
    """K3 + S6: predictions written partitioned by run and read back."""
    path = _scratch(spark, "predictions")
    IO.write_predictions(T.predictions(spark, sf), path)
    return IO.read_predictions(spark, path).select("run", "id", "y_true", "y_pred", "p")


@register("st1_stream_variants", lambda: S.with_ctes(S.lexicon_cte(), body=(
    "SELECT id, x_full, x_emoji, has_emoji, x_text, x_desc FROM (" +
    S.variants_sql(f"({S.documents_emoji_sql()})") + ")")))
def st1_stream_variants(spark, sf):
    """Streaming: documents as a file stream -> variants -> parquet sink
    (availableNow trigger), read back as a table."""
    from mojiframe.streaming.variants_stream import document_stream, start_to_parquet, variants_stream

    out, ck = _scratch(spark, "stream_out"), _scratch(spark, "stream_ckpt")
    v = variants_stream(document_stream(spark, sf))
    start_to_parquet(v, out, ck).awaitTermination()
    return spark.read.schema(v.schema).parquet(out)


def _split(spark, sf):
    from mojiframe.operators import splits as SP
    from mojiframe.plans.q_splits import DEV_SIZE, SEED

    return SP.stratified_split(T.corpus(spark, sf), DEV_SIZE, SEED)


def _split_sql() -> str:
    from mojiframe.plans.q_splits import DEV_SIZE, SEED

    return S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)


@register("k02_split_tables", lambda: f"SELECT id, split FROM {_split_sql()}")
def k02_split_tables(spark, sf):
    """K2: the split written as a table by split, with its one-row manifest, and read back."""
    path = _scratch(spark, "splits")
    IO.write_splits(_split(spark, sf), path, 42, 0.15, "test.csv")
    return spark.read.parquet(f"{path}/ids").select("id", "split")


@register("s04_split_manifest", lambda: f"SELECT id, split, true AS bounded FROM {_split_sql()}")
def s04_split_manifest(spark, sf):
    """The stored split as JSON manifests of at most 1,000 ids each, read back into rows; whether every array is as short."""
    path = _scratch(spark, "manifest")
    IO.write_splits(_split(spark, sf), f"{path}/table", 42, 0.15, "test.csv")
    IO.write_split_manifest(spark.read.parquet(f"{path}/table/ids").select("id", "split"), f"{path}/documents", 42, 0.15, "test.csv", per_document=1000)
    docs = spark.read.schema(IO.MANIFEST_SCHEMA).option("multiLine", True).json(f"{path}/documents")
    bounded = docs.agg(F.max(F.size("train_ids") + F.size("dev_ids")) <= 1000)
    return IO.read_split_manifest(spark, f"{path}/documents").select("id", "split", bounded.scalar().alias("bounded"))


@register("s05_train_dev_rows", lambda: (
    f"SELECT c.id, c.label, s.split FROM ({S.corpus_sql()}) c JOIN {_split_sql()} s ON c.id = s.id"))
def s05_train_dev_rows(spark, sf):
    """Train and dev rows selected by a stored split."""
    from mojiframe.operators.splits import select_split

    path = _scratch(spark, "splits")
    IO.write_splits(_split(spark, sf), path, 42, 0.15, "test.csv")
    splits, c = spark.read.parquet(f"{path}/ids"), T.corpus(spark, sf).select("id", "label")
    parts = [select_split(c, splits, w).withColumn("split", F.lit(w)) for w in ("train", "dev")]
    return parts[0].unionByName(parts[1])


@register("s02_test_file_variants", lambda: S.with_ctes(S.lexicon_cte(), body=(
    "SELECT label AS sarcastic, x_full, x_emoji, has_emoji, x_text, x_desc FROM (" + S.variants_sql(f"({S.corpus_sql()})") + ")")))
def s02_test_file_variants(spark, sf):
    """A test file without split or ids, read with the text column found by name."""
    path = _scratch(spark, "test_csv")
    c = T.corpus(spark, sf).select(F.col("id").alias("_c0"), F.col("text").alias("tweet"), F.col("label").alias("sarcastic"), "rephrase")
    IO.write_variants(c, path, fmt="csv")
    return IO.load_test(spark, path, IO.TRAIN_SCHEMA).select("sarcastic", "x_full", "x_emoji", "has_emoji", "x_text", "x_desc")


@register("s07_metrics_of_runs", lambda: (
    f"WITH {S.preds_cte()} SELECT run, accuracy, macro_f1 FROM (SELECT run, {S.metrics_sql()} FROM "
    f"(SELECT run, {S.CONFUSION_SQL} FROM preds GROUP BY run))"))
def s07_metrics_of_runs(spark, sf):
    """K5 + S7: metrics written as JSON and read with a schema; a missing folder adds nothing."""
    from mojiframe.operators import metrics as M

    path, schema = _scratch(spark, "metrics"), "run string, accuracy double, macro_f1 double"
    IO.write_json_table(M.compute_metrics(T.predictions(spark, sf)).select("run", "accuracy", "macro_f1"), path)
    return IO.read_json_table(spark, path, schema).unionByName(IO.read_json_table(spark, f"{path}-none", schema))


@register("k04_wide_predictions", lambda: f"WITH {S.preds_cte()} SELECT run, id, x_text, x_emoji, p, y_pred FROM preds")
def k04_wide_predictions(spark, sf):
    """K4: inputs beside their predictions, partitioned by run."""
    path = _scratch(spark, "wide")
    IO.write_wide_predictions(T.predictions(spark, sf).select("run", "id", "x_text", "x_emoji", "p", "y_pred"), path)
    return spark.read.parquet(path).select("run", "id", "x_text", "x_emoji", "p", "y_pred")


@register("k07_new_runs_appended", lambda: (
    f"WITH {S.preds_cte()} SELECT run, id, CASE WHEN run LIKE 'text_only%' THEN 0.0 ELSE p END AS p FROM preds"))
def k07_new_runs_appended(spark, sf):
    """K7: two runs stored first (with p = 0) stay as they are when all five are written."""
    path = _scratch(spark, "reused")
    p = T.predictions(spark, sf)
    IO.write_predictions(p.where(F.col("run").startswith("text_only")).withColumn("p", F.lit(0.0)), path)
    IO.write_predictions(p, path, existing="keep")
    return IO.read_predictions(spark, path).select("run", "id", "p")


@register("k06_refused_runs", lambda: (
    f"WITH {S.preds_cte()} SELECT run, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM preds WHERE run LIKE 'text_only%' GROUP BY run"))
def k06_refused_runs(spark, sf):
    """K6: a write that holds a stored run among new ones is refused whole; rows staged
    without a commit do not count either."""
    from mojiframe.sources import runlog

    path = _scratch(spark, "refused")
    p = T.predictions(spark, sf)
    IO.write_predictions(p.where(F.col("run").startswith("text_only")), path)
    try:
        IO.write_predictions(p, path)
        raise AssertionError("stored runs were written again")
    except FileExistsError:
        pass
    runlog.stage(p.where(~F.col("run").startswith("text_only")), path)  # its job ends before the commit
    return IO.read_predictions(spark, path).groupBy("run").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@register("k08_board_and_warnings", lambda: (
    f"WITH {S.preds_cte()}, m AS (SELECT run, {S.metrics_sql()} FROM (SELECT run, {S.CONFUSION_SQL} FROM preds GROUP BY run)) "
    f"SELECT run, CASE WHEN run LIKE 'concat%' OR run LIKE 'emoji_only%' THEN NULL ELSE macro_f1 END AS macro_f1, "
    f"CASE WHEN run LIKE 'concat%' THEN 'malformed metrics' WHEN run LIKE 'emoji_only%' THEN 'macro_f1 is missing' END AS warning FROM m "
    f"UNION ALL SELECT 'never_run', NULL, 'no metrics or config'"))
def k08_board_and_warnings(spark, sf):
    """K8: of the stored metrics one record is cut short, one lacks its macro-F1 and one expected run has none;
    the others are on the board, these among the warnings with their reasons."""
    from mojiframe.operators import metrics as M

    path, out = _scratch(spark, "run_metrics"), _scratch(spark, "board")
    m = M.compute_metrics(T.predictions(spark, sf)).select("run", "accuracy", "macro_f1")
    whole = F.to_json(F.struct("accuracy", F.when(~F.col("run").startswith("emoji_only"), F.col("macro_f1")).alias("macro_f1")))
    text = F.when(F.col("run").startswith("concat"), F.substring_index(whole, ",", 1)).otherwise(whole)
    m.select("run", text.alias("value")).write.partitionBy("run").text(path)
    good, failed = IO.read_run_metrics(spark, path, "accuracy double, macro_f1 double")
    expected = m.select("run").union(spark.createDataFrame([("never_run",)], "run string"))
    IO.write_leaderboard(good.select(F.col("run").alias("run_folder"), "macro_f1"), expected, out, failed=failed)
    board = spark.read.schema("run_folder string, macro_f1 double").json(f"{out}/leaderboard")
    warnings = spark.read.schema("run string, warning string").json(f"{out}/warnings")
    return board.select(F.col("run_folder").alias("run"), "macro_f1", F.lit(None).cast("string").alias("warning")).unionByName(
        warnings.select("run", F.lit(None).cast("double").alias("macro_f1"), "warning"))


@register("k09_stored_error_tables", lambda: (
    f"WITH {S.preds_cte()}, e AS (SELECT run, has_emoji, CASE WHEN y_true = 0 AND y_pred = 1 THEN 'fp' WHEN y_true = 1 AND y_pred = 0 "
    f"THEN 'fn' END AS kind FROM preds), k AS (SELECT run, kind, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY ALL UNION ALL "
    f"SELECT run, kind || '_emoji', count(*) FROM e WHERE kind IS NOT NULL AND has_emoji GROUP BY ALL) "
    f"SELECT run, kind, least(n, CASE WHEN kind LIKE '%emoji' THEN 25 ELSE 50 END) AS n FROM k"))
def k09_stored_error_tables(spark, sf):
    """K9: the error tables stored by run and kind, counted after reading them back."""
    from mojiframe.operators import errors as ER

    path = _scratch(spark, "errors")
    IO.write_errors(ER.top_errors(T.predictions(spark, sf), columns=["p", "y_true", "y_pred"]), path)
    return spark.read.parquet(path).groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n"))


@register("p07_chosen_columns", lambda: f"SELECT id, label, text AS readable, 0 AS missing_flag FROM ({S.corpus_sql()})")
def p07_chosen_columns(spark, sf):
    """Wanted columns that exist, the readable text column, a default for one that is not there."""
    from mojiframe.operators import variants as V

    c = T.corpus(spark, sf)
    return c.select(*V.pick_column(c, ["id", "not_there", "label"]), F.col(V.readable_text_column(c)).alias("readable"),
                    V.optional_column(c, "missing_flag"))


@register("s10_config_fallbacks", lambda: (
    "SELECT doc_id, coalesce(quality, CASE WHEN toxic = 1 THEN 7 END, 128) AS max_len FROM "
    "(SELECT doc_id, NULLIF(quality, 0) AS quality, toxic FROM labels)"))
def s10_config_fallbacks(spark, sf):
    """A stored value, else the configured one, else the default, over the label rows."""
    from mojiframe.sources import runs as RN

    rows = T.read_table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") != 0, F.col("quality")).alias("stored"), F.when(F.col("toxic") == 1, 7).alias("configured"))
    return RN.with_fallbacks(rows, "max_len", "stored", "configured", 128).select("doc_id", "max_len")
