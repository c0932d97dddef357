"""Error analysis (W1-W4, L1-L2, R2): false positives / negatives of every
run, most confident first, top-k per (run, kind).

The top-k is a ``row_number() <= k`` over ``partition by run, kind``; Spark
plans it as a partial ``WindowGroupLimit`` before the shuffle, so each task
ships at most k rows per group and a huge run or error kind cannot pile up
in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the columns of the error tables
ERROR_COLUMNS = ["text", "y_true", "y_pred", "p", "has_emoji", "x_text", "x_full", "x_emoji", "rephrase"]


def false_positives(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Label 0, predicted 1."""
    return df.where((F.col(y) == 0) & (F.col(p) == 1))


def false_negatives(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Label 1, predicted 0."""
    return df.where((F.col(y) == 1) & (F.col(p) == 0))


def error_kind(y: str = "y_true", p: str = "y_pred"):
    return (F.when((F.col(y) == 0) & (F.col(p) == 1), F.lit("fp"))
            .when((F.col(y) == 1) & (F.col(p) == 0), F.lit("fn")))


def _error_rows(df: DataFrame, key: str, id_col: str, score: str, flag: str, y: str, p: str, cols: list[str]) -> DataFrame:
    """Every error once per kind it belongs to (fp, fn, and fp_emoji, fn_emoji if it
    has emoji), with its sort key.  One scan.  W5: missing columns are an error."""
    need = list(dict.fromkeys([key, id_col, y, p, score, flag, *cols]))
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"error analysis needs the columns {', '.join(missing)}")
    e = df.select(*need).withColumn("kind", error_kind(y, p)).where(F.col("kind").isNotNull())
    e = e.withColumn("skey", F.when(F.col("kind") == "fp", -F.col(score)).otherwise(F.col(score)))
    both = F.array(F.col("kind"), F.concat("kind", F.lit("_emoji")))
    return e.withColumn("kind", F.explode(F.when(F.col(flag), both).otherwise(F.array("kind"))))


def _split_columns(df: DataFrame, inputs: DataFrame | None, columns: list[str], id_col: str) -> tuple[list[str], list[str]]:
    wide = [c for c in columns if inputs is not None and c in inputs.columns and c != id_col]
    return [c for c in columns if c not in wide], wide


def top_errors(df: DataFrame, k: int = 50, k_emoji: int = 25, key: str = "run",
               id_col: str = "id", score: str = "p", flag: str = "has_emoji",
               columns: list[str] | None = None, inputs: DataFrame | None = None,
               y: str = "y_true", p: str = "y_pred", derive=None) -> DataFrame:
    """R2: the four error tables of every run as one table
    ``(run, kind, rank, ...)`` with kind in fp, fn, fp_emoji, fn_emoji.

    L1: FP by score descending, FN ascending (ties by id).  L2: top k, and
    top k_emoji among errors with emoji (W4).  Ranking runs on narrow rows;
    ``inputs`` (keyed by id) is joined onto the top-k result only, which has at most
    k per (run, kind), and ``derive`` makes further columns of what was joined."""
    cols = list(columns or ERROR_COLUMNS)
    made = derive(inputs) if derive else inputs
    narrow, wide = _split_columns(df, made, cols, id_col)
    e = _error_rows(df, key, id_col, score, flag, y, p, narrow)
    # a literal bound lets Spark insert a partial WindowGroupLimit before the shuffle
    w = Window.partitionBy(key, "kind").orderBy("skey", id_col)
    top = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, k_emoji))
    top = top.where(F.col("rank") <= F.when(F.col("kind").endswith("_emoji"), k_emoji).otherwise(k))
    if inputs is not None:
        own = inputs.select(id_col, *[c for c in inputs.columns if c != id_col and c not in top.columns])
        top = top.join(own, id_col)
        top = derive(top) if derive else top
    return top.select(key, "kind", "rank", id_col, *cols)


def sorted_errors(df: DataFrame, key: str = "run", id_col: str = "id", score: str = "p", flag: str = "has_emoji",
                  columns: list[str] | None = None, inputs: DataFrame | None = None,
                  y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """L1 whole: every error of every run and kind with its rank, without a limit and
    without a window over (run, kind).  The rows are range-partitioned on (run,
    kind, score, id); a rank is the place within the partition plus the counts of the
    partitions before.  The sorted rows are checkpointed, as places must not change."""
    cols = list(columns or ERROR_COLUMNS)
    narrow, wide = _split_columns(df, inputs, cols, id_col)
    e = _error_rows(df, key, id_col, score, flag, y, p, narrow)
    e = e.repartitionByRange(key, "kind", "skey", id_col).sortWithinPartitions(key, "kind", "skey", id_col)
    e = e.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    runs = e.groupBy(key, "kind", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(key, "kind").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition and each (run, kind) that begins in one
    offset = runs.select(key, "kind", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    out = e.join(F.broadcast(offset), [key, "kind", "__part"]).withColumn("rank", F.col("__row") + F.col("__add"))
    if wide:
        out = out.join(inputs.select(id_col, *wide), id_col)
    return out.select(key, "kind", "rank", id_col, *cols)
