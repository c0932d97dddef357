"""Readers and writers.

CSV is read in splits, with an explicit schema, header, and RFC-4180 quoting so
quoted fields with doubled quotes and embedded newlines survive; everything the
toolkit writes is parquet (or JSON for small documents), partitioned by
``run`` where there are runs, so a run filter prunes partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mojiframe.sources import csvlines, runlog

TRAIN_SCHEMA = T.StructType([
    T.StructField("_c0", T.LongType()),
    T.StructField("tweet", T.StringType()),
    T.StructField("sarcastic", T.IntegerType()),
    T.StructField("rephrase", T.StringType()),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("y_true", T.IntegerType()),
    T.StructField("y_pred", T.IntegerType()),
    T.StructField("p_sarcastic", T.DoubleType()),
])

INDEX_COLUMNS = ("_c0", "Unnamed: 0")


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, id_col: str | None = None) -> DataFrame:
    """Header CSV with quoted multi-line fields, read in splits
    (``csvlines``); a stray index column (``_c0``, ``Unnamed: 0`` in pandas
    exports) is dropped; ``id_col`` numbers the rows from 0 in file order."""
    df = csvlines.read_csv(spark, path, schema, id_col)
    return df.drop(*[c for c in INDEX_COLUMNS if c in df.columns])


def with_row_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """0-based contiguous row ids in scan order, like ``zipWithIndex`` but
    JVM-only: ``monotonically_increasing_id`` numbers rows inside each
    partition; per-partition counts (one row per partition, a bounded
    broadcast) give each partition its offset.  No global sort, no single
    task.  The input must be a deterministic scan (a file read)."""
    from pyspark.sql import Window

    t = df.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    counts = t.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    j = t.join(F.broadcast(offsets), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return j.select(*df.columns, (F.col("__off") + local).alias(name))


def load_train(spark: SparkSession, path: str) -> DataFrame:
    """S1+S3+P4+F13: labelled training file -> variants with ids."""
    from mojiframe.operators.variants import add_variants

    return add_variants(read_labelled_csv(spark, path, TRAIN_SCHEMA, "id"))


def load_test(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Official test file -> variants (no split, no ids)."""
    from mojiframe.operators.variants import add_variants

    return add_variants(read_labelled_csv(spark, path, schema))


def load_train_dev(spark: SparkSession, path: str, splits_path: str) -> tuple[DataFrame, DataFrame]:
    """Train and dev rows by semi join with the stored ``(id, split)``."""
    from mojiframe.operators.splits import select_split

    df = load_train(spark, path)
    splits = spark.read.parquet(splits_path)
    return select_split(df, splits, "train"), select_split(df, splits, "dev")


MANIFEST_SCHEMA = T.StructType([
    T.StructField("train_ids", T.ArrayType(T.LongType())),
    T.StructField("dev_ids", T.ArrayType(T.LongType())),
    T.StructField("test_file", T.StringType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("dev_size", T.DoubleType()),
])


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON manifests (id arrays), one document a file -> ``(id, split)`` rows."""
    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return (m.select(F.explode("train_ids").alias("id"), F.lit("train").alias("split"))
            .unionByName(m.select(F.explode("dev_ids").alias("id"), F.lit("dev").alias("split"))))


def write_splits(splits: DataFrame, path: str, seed: int, dev_size: float, test_file: str,
                 mode: str = "errorifexists") -> None:
    """K2: the split as an ``(id, split)`` table plus a one-row manifest; the
    ids are never gathered into one array."""
    splits.select("id", "split").write.mode(mode).partitionBy("split").parquet(f"{path}/ids")
    spark = splits.sparkSession
    spark.createDataFrame([(seed, float(dev_size), test_file)],
                          "seed int, dev_size double, test_file string") \
        .write.mode(mode).json(f"{path}/manifest")


def write_split_manifest(splits: DataFrame, path: str, seed: int, dev_size: float, test_file: str, per_document: int = 100_000,
                         mode: str = "errorifexists") -> None:
    """S4's form written at any size: JSON documents with ``train_ids`` and ``dev_ids``, a
    file each, of at most ``per_document`` ids, so that no split passes through one array.
    A block of a partition's rows is one document; ``splits`` (id not null, split) should be
    a stored table, whose rows come in the same order when a task runs again."""
    place = F.monotonically_increasing_id()  # partition above bit 33, row below
    block = F.struct(F.shiftright(place, 33).alias("part"), F.floor(F.pmod(place, F.lit(1 << 33)) / per_document).alias("n"))
    ids = [F.collect_list(F.when(F.col("split") == s, F.col("id"))).alias(f"{s}_ids") for s in ("train", "dev")]
    docs = splits.where(F.col("split").isin("train", "dev")).withColumn("__block", block).groupBy("__block").agg(*ids)
    docs = docs.select("train_ids", "dev_ids", F.lit(test_file).alias("test_file"), F.lit(seed).alias("seed"), F.lit(float(dev_size)).alias("dev_size"))
    docs.write.mode(mode).option("maxRecordsPerFile", 1).json(path)


def _read_or_none(read):
    """A read whose path may be missing; any other failure is an error."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_predictions(preds: DataFrame, path: str, existing: str = "error") -> None:
    """K3, K6, K7: ``(run, id, y_true, y_pred, p)`` partitioned by run, through the commit log (see ``runlog.append_runs``)."""
    runlog.append_runs(preds.select("run", "id", "y_true", "y_pred", "p"), path, existing)


def write_errors(errors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K9: error tables partitioned by run and kind."""
    errors.write.mode(mode).partitionBy("run", "kind").parquet(path)


def read_run_metrics(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("accuracy", "macro_f1")) -> tuple[DataFrame, DataFrame]:
    """The JSON metrics under ``run=<run>`` folders, and the runs that failed with
    their ``warning``: a record that does not parse, lacks a required number, or has one
    that is not between 0 and 1.  One bad record sets its run aside, not the read."""
    df = _read_or_none(lambda: spark.read.schema(f"{schema}, _broken string, run string").option("mode", "PERMISSIVE")
                       .option("columnNameOfCorruptRecord", "_broken").json(path))
    if df is None:
        df = spark.createDataFrame([], f"{schema}, _broken string, run string")
    reason = F.when(F.col("_broken").isNotNull(), F.lit("malformed metrics"))
    for c in required:
        reason = reason.when(F.col(c).isNull(), F.lit(f"{c} is missing"))
        reason = reason.when(F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1), F.lit(f"{c} is not between 0 and 1"))
    judged = df.withColumn("warning", reason)
    failed = judged.where(F.col("warning").isNotNull()).groupBy("run").agg(F.min("warning").alias("warning"))
    return judged.join(failed.select("run"), "run", "left_anti").drop("_broken", "warning"), failed


def write_leaderboard(board: DataFrame, expected: DataFrame, path: str, mode: str = "errorifexists", failed: DataFrame | None = None) -> None:
    """K8: the leaderboard as JSON lines, and beside it a table of warnings: the runs
    that failed with their reason, and each other expected run that has no place on the board."""
    board.write.mode(mode).json(f"{path}/leaderboard")
    lost = expected.select("run").distinct().join(board.select(F.col("run_folder").alias("run")), "run", "left_anti")
    if failed is None:
        failed = expected.sparkSession.createDataFrame([], "run string, warning string")
    other = lost.join(failed, "run", "left_anti").select("run", F.lit("no metrics or config").alias("warning"))
    failed.select("run", "warning").unionByName(other).write.mode(mode).json(f"{path}/warnings")


def read_predictions(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The committed runs in one scan; a run filter prunes partitions."""
    return runlog.read_runs(spark, path, runs)


def write_wide_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K4: inputs plus ``p`` and ``y_pred``, partitioned by run."""
    df.write.mode(mode).partitionBy("run").parquet(path)


def write_json_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5/K8/K9: metrics, leaderboard, error tables as JSON lines."""
    df.write.mode(mode).json(path)


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON documents of many runs; a missing folder is an empty table."""
    if schema is None:
        return spark.read.json(path)
    df = _read_or_none(lambda: spark.read.schema(schema).json(path))
    return spark.createDataFrame([], schema) if df is None else df


def write_variants(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """K1: the processed corpus with its variants."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
