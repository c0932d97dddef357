"""Classification metrics as grouped aggregates.

All runs and slices are evaluated in one pass: ``groupBy(run)`` (or grouping
sets over run and slice) with map-side partial counts, so the shuffle carries
a handful of integers per group and task, whatever the number of rows; a hot
run or slice cannot skew it.  Metric formulas use only the four integer cells,
so they are exact and identical on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    """a / b as double, 0 when b == 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_aggs(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """G1: the 2x2 grid with labels fixed to [0, 1]; zero cells kept."""
    yc, pc = F.col(y), F.col(p)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((yc == 0) & (pc == 0)).alias("tn"),
        F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"),
        F.count_if((yc == 1) & (pc == 1)).alias("tp"),
    ]


def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> list[Column]:
    """G2-G6 from the four cells."""
    tn, fp, fn, tp = F.col(tn), F.col(fp), F.col(fn), F.col(tp)
    n = tn + fp + fn + tp
    f0 = _div(2 * tn, 2 * tn + fp + fn)
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    # macro-F1 averages over the labels present in y_true or y_pred
    pres0 = ((tn + fp) + (tn + fn)) > 0
    pres1 = ((tp + fn) + (tp + fp)) > 0
    npres = pres0.cast("int") + pres1.cast("int")
    macro = F.try_divide(F.when(pres0, f0).otherwise(0.0) + F.when(pres1, f1).otherwise(0.0),
                         npres.cast("double"))
    return [
        _div(tn + tp, n).alias("accuracy"),
        F.coalesce(macro, F.lit(0.0)).alias("macro_f1"),
        _div(tn, tn + fn).alias("p0"), _div(tn, tn + fp).alias("r0"), f0.alias("f0"),
        (tn + fp).cast("double").alias("s0"),
        _div(tp, tp + fp).alias("p1"), _div(tp, tp + fn).alias("r1"), f1.alias("f1"),
        (tp + fn).cast("double").alias("s1"),
    ]


def confusion(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_aggs(y, p))


def compute_metrics(df: DataFrame, keys: list[str] = ["run"], y: str = "y_true",
                    p: str = "y_pred") -> DataFrame:
    """``keys + n, tn, fp, fn, tp, accuracy, macro_f1, p0..s1``."""
    c = confusion(df, keys, y, p)
    return c.select("*", *metric_columns())


def confusion_long(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """G1 long form ``keys + (y_true, y_pred, n)``: all four cells, zeros kept,
    by unpivoting the wide counts (no grid join needed)."""
    c = confusion(df, keys, y, p)
    return c.select(*keys, F.expr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp)").alias("y_true", "y_pred", "cnt"))


def slice_name(flag: str = "has_emoji") -> Column:
    return (F.when(F.grouping(flag) == 1, F.lit("all"))
            .when(F.col(flag), F.lit("emoji")).otherwise(F.lit("no_emoji")))


def metrics_by_slice(df: DataFrame, key: str = "run", flag: str = "has_emoji",
                     y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Metrics over all rows, the emoji rows and the no-emoji rows of each
    run in one aggregate (``GROUPING SETS ((run), (run, flag))``).  An empty
    slice has no row."""
    g = (df.groupingSets([[key], [key, flag]], key, flag)
         .agg(*confusion_aggs(y, p), slice_name(flag).alias("slice")))
    return g.select(key, "slice", "n", "tn", "fp", "fn", "tp", *metric_columns())


def metrics_on_subset(df: DataFrame, ids: DataFrame, keys: list[str] = ["run"],
                      key: str = "id") -> DataFrame:
    """G9 with J2: metrics restricted to the ids of ``ids`` (left semi join)."""
    return compute_metrics(df.join(ids.select(key), key, "left_semi"), keys)


# class weights -------------------------------------------------------------
def class_weight_w1(df: DataFrame, label: str = "label") -> DataFrame:
    """``w0 = 1``, ``w1 = n0 / max(n1, 1)``."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n0"),
        F.count_if(F.col(label) == 1).alias("n1"),
    ).select("n0", "n1", F.lit(1.0).alias("w0"),
             (F.col("n0").cast("double") / F.greatest(F.col("n1"), F.lit(1)).cast("double")).alias("w1"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (n_classes * n_c)`` per class."""
    from pyspark.sql import Window

    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    all_ = Window.partitionBy()
    return c.select(label, "n_c", (F.sum("n_c").over(all_).cast("double")
                                   / (F.count(F.lit(1)).over(all_) * F.col("n_c")).cast("double")).alias("weight"))


def error_summary(df: DataFrame, key: str = "run", y: str = "y_true", p: str = "y_pred",
                  flag: str = "has_emoji") -> DataFrame:
    """FP and FN counts and emoji rates inside them (3 decimals)."""
    is_fp = (F.col(y) == 0) & (F.col(p) == 1)
    is_fn = (F.col(y) == 1) & (F.col(p) == 0)
    e = F.col(flag).cast("int")
    return df.groupBy(key).agg(
        F.count_if(is_fp).alias("fp_count"),
        F.count_if(is_fn).alias("fn_count"),
        F.round(F.coalesce(F.avg(F.when(is_fp, e)), F.lit(0.0)), 3).alias("fp_emoji_rate"),
        F.round(F.coalesce(F.avg(F.when(is_fn, e)), F.lit(0.0)), 3).alias("fn_emoji_rate"),
    )


# epoch tables ---------------------------------------------------------------
def epoch_loss(steps: DataFrame, keys: list[str] = ["run", "epoch"], loss: str = "loss") -> DataFrame:
    """Mean loss per epoch, ``sum(loss) / max(n_steps, 1)``."""
    return steps.groupBy(*keys).agg(
        (F.sum(loss) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_loss"))


def best_epoch(epochs: DataFrame, key: str = "run", epoch: str = "epoch",
               score: str = "macro_f1", tol: float = 1e-6, patience: int | None = None) -> DataFrame:
    """The running rule "new best if score > best + tol", optionally
    stopping after ``patience`` epochs without improvement.  A fold over the
    epochs of each run, in epoch order (epochs per run are few)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(score).alias("s"))))
    init = F.struct(F.lit(-1.0e300).alias("best"), F.lit(None).cast("long").alias("best_epoch"),
                    F.lit(0).alias("bad"), F.lit(False).alias("stopped"),
                    F.lit(None).cast("long").alias("stop_epoch"))

    def step(acc, x):
        improve = (~acc["stopped"]) & (x["s"] > acc["best"] + F.lit(tol))
        bad = F.when(acc["stopped"], acc["bad"]).when(improve, F.lit(0)).otherwise(acc["bad"] + 1)
        stop_now = (~acc["stopped"]) & (~improve) & (bad >= patience) if patience is not None else F.lit(False)
        return F.struct(
            F.when(improve, x["s"]).otherwise(acc["best"]).alias("best"),
            F.when(improve, x["e"].cast("long")).otherwise(acc["best_epoch"]).alias("best_epoch"),
            bad.alias("bad"),
            (acc["stopped"] | stop_now).alias("stopped"),
            F.when(stop_now, x["e"].cast("long")).otherwise(acc["stop_epoch"]).alias("stop_epoch"),
        )

    folded = epochs.groupBy(key).agg(F.aggregate(ordered, init, step).alias("f"))
    return folded.select(key, F.col("f.best_epoch").alias("best_epoch"),
                         F.col("f.best").alias("best_score"),
                         F.col("f.stop_epoch").alias("stop_epoch"))
