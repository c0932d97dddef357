"""Reports over many runs.

Each report is one grouped query over the predictions/metrics tables; the
per-run Python loops of the reference become grouping keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiframe.functions import text as TX


def _pick(slice_name: str, col: str):
    return F.max(F.when(F.col("slice") == slice_name, F.col(col)))


def leaderboard(by_slice: DataFrame, configs: DataFrame) -> DataFrame:
    """R3 (+J4): one row per run with config and test metrics, best first.
    Runs lacking a config or metrics are dropped (inner join)."""
    wide = by_slice.groupBy("run").agg(
        _pick("all", "macro_f1").alias("test_macro_f1"),
        _pick("all", "accuracy").alias("test_accuracy"),
        _pick("emoji", "macro_f1").alias("emoji_subset_f1"),
        _pick("no_emoji", "macro_f1").alias("no_emoji_subset_f1"),
    )
    lb = wide.join(configs.select("run", "fusion_mode", F.col("text_col").alias("text_col_used")), "run")
    return lb.select(F.col("run").alias("run_folder"), "fusion_mode", "text_col_used", "test_macro_f1",
                     "test_accuracy", "emoji_subset_f1", "no_emoji_subset_f1") \
             .orderBy(F.col("test_macro_f1").desc_nulls_last(), "run_folder")


def comparison_table(expected: DataFrame, metrics: DataFrame, digits: int = 4) -> DataFrame:
    """R4 (+S7, J7): every expected run, its metrics formatted to ``digits``
    decimals or ``MISSING``; ``macro_f1_or_0`` is the zero-filled variant."""
    j = expected.select("run").join(metrics.select("run", "macro_f1", "accuracy"), "run", "left")
    fmt = lambda c: F.when(F.col(c).isNull(), F.lit("MISSING")).otherwise(
        F.format_string(f"%.{digits}f", F.col(c)))
    return j.select("run", fmt("macro_f1").alias("macro_f1_fmt"), fmt("accuracy").alias("accuracy_fmt"),
                    F.coalesce(F.col("macro_f1"), F.lit(0.0)).alias("macro_f1_or_0"))


def missing_runs(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Expected runs with no prediction rows (left anti join).  Runs are made
    distinct first (map-side), so the join sees one row a run."""
    return expected.select("run").join(predictions.select("run").distinct(), "run", "left_anti")


def run_pair_agreement(predictions: DataFrame, run_a: str, run_b: str,
                       y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per-id correctness of two runs side by side, counted as
    (both right, a only, b only, both wrong).  One grouping by id replaces
    the self-join: each id's two rows meet in the same task."""
    correct = (F.col(y) == F.col(p)).cast("int")
    per_id = (predictions.where(F.col("run").isin(run_a, run_b))
              .groupBy("id").agg(F.max(F.when(F.col("run") == run_a, correct)).alias("a"),
                                 F.max(F.when(F.col("run") == run_b, correct)).alias("b")))
    return per_id.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_right"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("a_only"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b_only"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("both_wrong"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"),
    )


def metric_delta(metrics: DataFrame, run_a: str, run_b: str, col: str = "macro_f1") -> DataFrame:
    """``metric(run_a) - metric(run_b)`` (NULL if either is missing)."""
    return metrics.agg(
        F.max(F.when(F.col("run") == run_a, F.col(col))).alias("a"),
        F.max(F.when(F.col("run") == run_b, F.col(col))).alias("b"),
    ).select(F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b"),
             (F.col("a") - F.col("b")).alias(f"delta_{col}"))


def corpus_stats(labelled: DataFrame, split_col: str = "split", label: str = "label",
                 flag: str = "has_emoji", rephrase: str = "rephrase") -> DataFrame:
    """R7 (G10-G13): per split and overall (rollup): rows, emoji rate,
    positive rate, label counts, non-null rephrase count."""
    g = labelled.rollup(split_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col(flag).cast("int")), 3).alias("emoji_rate"),
        F.round(F.avg(F.col(label).cast("double")), 3).alias("positive_rate"),
        F.count_if(F.col(label) == 0).alias("n_label0"),
        F.count_if(F.col(label) == 1).alias("n_label1"),
        F.count(rephrase).alias("n_rephrase"),
        F.grouping(split_col).alias("g"),
    )
    return g.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(split_col)).alias("split"),
                    "n", "emoji_rate", "positive_rate", "n_label0", "n_label1", "n_rephrase")


def emoji_frequency(df: DataFrame, text: str = "text", sequences: bool = False) -> DataFrame:
    """Emoji (code points, or whole sequences) -> occurrences and
    number of texts containing it.  A text counts its own emoji, so the shuffle
    carries two partial sums per emoji and task and no ids."""
    pat = "(" + (TX.SEQ_FAST if sequences else TX.EMOJI_FAST) + ")"
    found = df.select(F.regexp_extract_all(F.col(text), F.lit(pat), 1).alias("found"))
    own = found.select("found", F.explode_outer(F.array_distinct("found")).alias("emoji")).where(F.col("emoji").isNotNull())
    own = own.select("emoji", F.size(F.filter("found", lambda x: x == F.col("emoji"))).alias("times"))
    return own.groupBy("emoji").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("n_texts"))


def chart_series(by_slice: DataFrame) -> DataFrame:
    """Chart-ready long table ``(series, x, y)``: macro-F1 and accuracy per
    run, macro-F1 per run and emoji slice, and the confusion cells per run."""
    m = by_slice.select(
        "run", "slice",
        F.expr("stack(6, 'macro_f1', macro_f1, 'accuracy', accuracy, 'tn', CAST(tn AS DOUBLE), "
               "'fp', CAST(fp AS DOUBLE), 'fn', CAST(fn AS DOUBLE), 'tp', CAST(tp AS DOUBLE))")
        .alias("metric", "y"))
    return m.select(F.concat_ws(":", "slice", "metric").alias("series"), F.col("run").alias("x"), "y")
