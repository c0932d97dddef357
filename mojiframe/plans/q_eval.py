"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mojiframe.operators import metrics as M
from mojiframe.operators import splits as SP
from mojiframe.plans import sqltext as S
from mojiframe.plans.catalog import register
from mojiframe.plans.q_splits import DEV_SIZE, SEED
from mojiframe.sources import runs as RN
from mojiframe.sources import tables as T


def preds(spark, sf):
    return T.predictions(spark, sf)


def _w(body: str) -> str:
    return f"WITH {S.preds_cte()}\n{body}"


def _metrics_body(keys: str = "run", rel: str = "preds", where: str = "") -> str:
    return (f"SELECT {keys}, n, tn, fp, fn, tp, {S.metrics_sql()} FROM "
            f"(SELECT {keys}, {S.CONFUSION_SQL} FROM {rel} {where} GROUP BY {keys})")


@register("g01_confusion", lambda: _w(
    "SELECT run, y_true, y_pred, cnt FROM (SELECT run, " + S.CONFUSION_SQL + " FROM preds GROUP BY run) c, "
    "LATERAL (VALUES (0, 0, c.tn), (0, 1, c.fp), (1, 0, c.fn), (1, 1, c.tp)) AS t(y_true, y_pred, cnt)"))
def g01_confusion(spark, sf):
    return M.confusion_long(preds(spark, sf), ["run"])


def _sub(cols: str) -> str:
    return _w(f"SELECT run, {cols} FROM ({_metrics_body()})")


@register("g02_accuracy", lambda: _sub("accuracy"))
def g02_accuracy(spark, sf):
    return M.compute_metrics(preds(spark, sf)).select("run", "accuracy")


@register("g03_precision", lambda: _sub("p0, p1"))
def g03_precision(spark, sf):
    return M.compute_metrics(preds(spark, sf)).select("run", "p0", "p1")


@register("g04_recall", lambda: _sub("r0, r1"))
def g04_recall(spark, sf):
    return M.compute_metrics(preds(spark, sf)).select("run", "r0", "r1")


@register("g05_f1_support", lambda: _sub("f0, f1, s0, s1"))
def g05_f1_support(spark, sf):
    return M.compute_metrics(preds(spark, sf)).select("run", "f0", "f1", "s0", "s1")


@register("g06_macro_f1", lambda: _sub("macro_f1"))
def g06_macro_f1(spark, sf):
    return M.compute_metrics(preds(spark, sf)).select("run", "macro_f1")


@register("g07_metrics", lambda: _w(_metrics_body()))
def g07_metrics(spark, sf):
    return M.compute_metrics(preds(spark, sf))


@register("g08_metrics_by_slice", lambda: _w(S.by_slice_sql()))
def g08_metrics_by_slice(spark, sf):
    return M.metrics_by_slice(preds(spark, sf))


def _dev_emoji_ids_sql() -> str:
    return (f"SELECT s.id FROM {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)} s "
            f"JOIN (SELECT id, has_emoji FROM ({S.corpus_variants_sql()})) v ON s.id = v.id "
            f"WHERE s.split = 'dev' AND v.has_emoji")


def dev_emoji_ids(spark, sf):
    from mojiframe.operators.variants import add_variants

    s = SP.stratified_split(add_variants(T.corpus(spark, sf)), DEV_SIZE, SEED, keep=["has_emoji"])
    return s.where((F.col("split") == "dev") & F.col("has_emoji")).select("id")


@register("g09_metrics_on_subset", lambda: _w(
    f"SELECT run, accuracy, macro_f1 FROM ({_metrics_body(where=f'WHERE id IN ({_dev_emoji_ids_sql()})')})"))
def g09_metrics_on_subset(spark, sf):
    return M.metrics_on_subset(preds(spark, sf), dev_emoji_ids(spark, sf)).select("run", "accuracy", "macro_f1")


def _train_sql() -> str:
    return (f"SELECT c.* FROM ({S.corpus_sql()}) c JOIN {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)} s "
            f"ON c.id = s.id WHERE s.split = 'train'")


def train_rows(spark, sf):
    """The training rows' ids and labels, straight from the split."""
    return SP.stratified_split(T.corpus(spark, sf), DEV_SIZE, SEED).where(F.col("split") == "train")


@register("g14_class_weight", lambda: (
    f"SELECT n0, n1, 1.0 AS w0, CAST(n0 AS DOUBLE) / CAST(greatest(n1, 1) AS DOUBLE) AS w1 FROM "
    f"(SELECT count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM ({_train_sql()}))"))
def g14_class_weight(spark, sf):
    return M.class_weight_w1(train_rows(spark, sf))


@register("g15_balanced_weights", lambda: (
    f"SELECT label, n_c, CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(*) OVER () * n_c AS DOUBLE) AS weight "
    f"FROM (SELECT label, count(*) AS n_c FROM ({_train_sql()}) GROUP BY label)"))
def g15_balanced_weights(spark, sf):
    return M.balanced_weights(train_rows(spark, sf))


@register("g17_error_summary", lambda: _w(
    "SELECT run, count_if(y_true = 0 AND y_pred = 1) AS fp_count, count_if(y_true = 1 AND y_pred = 0) AS fn_count, "
    "round(coalesce(avg(CASE WHEN y_true = 0 AND y_pred = 1 THEN CAST(has_emoji AS INTEGER) END), 0.0), 3) "
    "AS fp_emoji_rate, "
    "round(coalesce(avg(CASE WHEN y_true = 1 AND y_pred = 0 THEN CAST(has_emoji AS INTEGER) END), 0.0), 3) "
    "AS fn_emoji_rate FROM preds GROUP BY run"))
def g17_error_summary(spark, sf):
    return M.error_summary(preds(spark, sf))


# Per-row weighted cross-entropy; steps are batches of 16 rows ----
EPS = 1e-7
BATCH = 16


def row_loss():
    p = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    py = F.when(F.col("y_true") == 1, p).otherwise(1 - p)
    return -F.ln(py)


def _row_loss_sql() -> str:
    p = f"least(greatest(p, {EPS!r}), {1 - EPS!r})"
    return f"-ln(CASE WHEN y_true = 1 THEN {p} ELSE 1 - {p} END)"


@register("g18_epoch_loss", lambda: _w(
    f"SELECT run, round(sum(loss) / greatest(count(*), 1), 6) AS mean_loss FROM ("
    f"SELECT run, id // {BATCH} AS step, avg({_row_loss_sql()}) AS loss FROM preds GROUP BY run, id // {BATCH}) "
    f"GROUP BY run"))
def g18_epoch_loss(spark, sf):
    steps = (preds(spark, sf).groupBy("run", F.floor(F.col("id") / BATCH).alias("step"))
             .agg(F.avg(row_loss()).alias("loss")))
    return M.epoch_loss(steps, ["run"]).select("run", F.round("mean_loss", 6).alias("mean_loss"))


def _w1_sql() -> str:
    return ("(SELECT CAST(count_if(label = 0) AS DOUBLE) / CAST(greatest(count_if(label = 1), 1) AS DOUBLE) "
            f"FROM ({S.corpus_sql()}))")


@register("m15_weighted_ce", lambda: _w(
    f"SELECT run, round(sum(w * l) / sum(w), 6) AS weighted_ce FROM (SELECT run, {_row_loss_sql()} AS l, "
    f"CASE WHEN y_true = 1 THEN {_w1_sql()} ELSE 1.0 END AS w FROM preds) GROUP BY run"))
def m15_weighted_ce(spark, sf):
    # w1 is a scalar subquery: evaluated once, substituted as a value
    w1 = M.class_weight_w1(T.corpus(spark, sf)).select("w1").scalar()
    w = F.when(F.col("y_true") == 1, w1).otherwise(F.lit(1.0))
    return preds(spark, sf).groupBy("run").agg(F.round(F.sum(w * row_loss()) / F.sum(w), 6).alias("weighted_ce"))


# epochs = the five runs read as five epochs of one training ------
def _best_epoch_sql(patience: int | None) -> str:
    """The running rule as a recursive walk over the epochs."""
    from mojiframe.sources.tables import N_RUNS, PRED_A, PRED_B

    p = f"(CAST(((c.id * {PRED_A} + e * {PRED_B}) % 1000) AS DOUBLE) / 1000.0)"
    stop = f"s.bad + 1 >= {patience}" if patience is not None else "false"
    better = "NOT s.stopped AND m.macro_f1 > s.best + 1e-6"
    return (f"WITH RECURSIVE ep AS (SELECT e AS epoch, {S.CONFUSION_SQL} FROM ("
            f"SELECT e, c.label AS y_true, CAST({p} >= 0.5 AS INTEGER) AS y_pred FROM ({S.corpus_sql()}) c, "
            f"(SELECT unnest(range(1, {N_RUNS + 1})) AS e)) GROUP BY e), "
            f"m AS (SELECT epoch, {S.metrics_sql()} FROM ep), "
            f"s AS (SELECT CAST(0 AS BIGINT) AS epoch, CAST(-1e300 AS DOUBLE) AS best, CAST(NULL AS BIGINT) AS best_epoch, 0 AS bad, "
            f"false AS stopped, CAST(NULL AS BIGINT) AS stop_epoch UNION ALL "
            f"SELECT m.epoch, CASE WHEN {better} THEN m.macro_f1 ELSE s.best END, CASE WHEN {better} THEN m.epoch ELSE s.best_epoch END, "
            f"CASE WHEN s.stopped THEN s.bad WHEN {better} THEN 0 ELSE s.bad + 1 END, "
            f"s.stopped OR (NOT ({better}) AND {stop}), "
            f"CASE WHEN NOT s.stopped AND NOT ({better}) AND {stop} THEN m.epoch ELSE s.stop_epoch END "
            f"FROM s JOIN m ON m.epoch = s.epoch + 1) "
            f"SELECT 'training' AS run, best_epoch, best AS best_score, stop_epoch FROM s ORDER BY epoch DESC LIMIT 1")


@register("g19_best_epoch", lambda: _best_epoch_sql(None))
def g19_best_epoch(spark, sf):
    p = T.with_runs(T.corpus(spark, sf)).withColumn("y_true", F.col("label")) \
        .withColumn("p", T.prediction_p(F.col("id"), F.col("run_no"))) \
        .withColumn("y_pred", (F.col("p") >= 0.5).cast("int"))
    ep = M.compute_metrics(p, ["run_no"]).select(F.lit("training").alias("run"),
                                                  F.col("run_no").alias("epoch"), "macro_f1")
    return M.best_epoch(ep, "run", "epoch", "macro_f1")


@register("g20_early_stop", lambda: _best_epoch_sql(2))
def g20_early_stop(spark, sf):
    p = T.with_runs(T.corpus(spark, sf)).withColumn("y_true", F.col("label")) \
        .withColumn("p", T.prediction_p(F.col("id"), F.col("run_no"))) \
        .withColumn("y_pred", (F.col("p") >= 0.5).cast("int"))
    ep = M.compute_metrics(p, ["run_no"]).select(F.lit("training").alias("run"),
                                                  F.col("run_no").alias("epoch"), "macro_f1")
    return M.best_epoch(ep, "run", "epoch", "macro_f1", patience=2)


# filters ---------------------------------------------------------------------
@register("w1_false_positives", lambda: _w("SELECT run, id, p FROM preds WHERE y_true = 0 AND y_pred = 1"))
def w1_false_positives(spark, sf):
    from mojiframe.operators.errors import false_positives

    return false_positives(preds(spark, sf)).select("run", "id", "p")


@register("w2_false_negatives", lambda: _w("SELECT run, id, p FROM preds WHERE y_true = 1 AND y_pred = 0"))
def w2_false_negatives(spark, sf):
    from mojiframe.operators.errors import false_negatives

    return false_negatives(preds(spark, sf)).select("run", "id", "p")


@register("w3_emoji_slice", lambda: _w("SELECT run, count(*) AS n, count_if(y_true = y_pred) AS n_correct "
                                       "FROM preds WHERE has_emoji GROUP BY run"))
def w3_emoji_slice(spark, sf):
    return (preds(spark, sf).where(F.col("has_emoji")).groupBy("run")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("n_correct")))


@register("w6_select_run", lambda: _w(
    _metrics_body(where="WHERE run IN (SELECT run FROM (" + S.runs_sql() +
                  ") WHERE fusion_mode = 'gated' AND text_col = 'x_text')")))
def w6_select_run(spark, sf):
    cfg = RN.run_config(spark).where((F.col("fusion_mode") == "gated") & (F.col("text_col") == "x_text"))
    # the plan itself fails unless exactly one run matches
    one = cfg.agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("run")).select(
        F.when(F.col("n") == 1, F.col("run")).otherwise(F.raise_error(F.lit("run selector must match exactly one run"))).alias("run"))
    chosen = preds(spark, sf).join(F.broadcast(one), "run", "left_semi")
    return M.compute_metrics(chosen)


@register("w7_class_membership", lambda: (
    f"SELECT count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM ({S.corpus_sql()})"))
def w7_class_membership(spark, sf):
    c = T.corpus(spark, sf)
    return c.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


@register("j2_subset_predictions", lambda: _w(
    f"SELECT run, id, y_pred FROM preds WHERE id IN ({_dev_emoji_ids_sql()})"))
def j2_subset_predictions(spark, sf):
    return preds(spark, sf).join(dev_emoji_ids(spark, sf), "id", "left_semi").select("run", "id", "y_pred")


@register("j3_predictions_with_inputs", lambda: _w(
    f"SELECT p.run, p.id, v.x_text, v.x_emoji, p.p, p.y_pred FROM "
    f"(SELECT run, id, p, y_pred FROM preds) p JOIN ({S.corpus_variants_sql()}) v ON p.id = v.id"))
def j3_predictions_with_inputs(spark, sf):
    from mojiframe.operators.variants import add_variants

    narrow = preds(spark, sf).select("run", "id", "p", "y_pred")
    v = add_variants(T.corpus(spark, sf)).select("id", "x_text", "x_emoji")
    return narrow.join(v, "id").select("run", "id", "x_text", "x_emoji", "p", "y_pred")
