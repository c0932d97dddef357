"""Registered report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mojiframe.operators import errors as ER
from mojiframe.operators import metrics as M
from mojiframe.operators import reports as R
from mojiframe.plans import sqltext as S
from mojiframe.plans.catalog import register
from mojiframe.plans.q_eval import _dev_emoji_ids_sql, _metrics_body, _w, dev_emoji_ids, preds
from mojiframe.session import checkpoint_dir
from mojiframe.sources import runs as RN
from mojiframe.sources import tables as T

# R4 expects one run that was configured but never produced predictions.
EXTRA_EXPECTED = ("gated", "x_full")


def _name(mode: str, col: str) -> str:
    from mojiframe.sources.runs import SHARED

    return (f"{mode}_{col}_roberta_lr{SHARED['lr']:.0e}_ep{SHARED['epochs']}"
            f"_bs{SHARED['batch_size']}_seed{SHARED['seed']}")


RUN_A = _name("text_only", "x_full")
RUN_B = _name("text_only", "x_text")

_ERR_COLS = ["x_text", "x_emoji", "p", "y_true", "y_pred", "has_emoji"]


def _ranked_sql(k: int | None, k_emoji: int | None) -> str:
    kind = "CASE WHEN y_true = 0 AND y_pred = 1 THEN 'fp' WHEN y_true = 1 AND y_pred = 0 THEN 'fn' END"
    cols = ", ".join(_ERR_COLS)
    e = f"(SELECT run, id, {cols}, {kind} AS kind FROM preds WHERE {kind} IS NOT NULL)"
    emo = f"(SELECT run, id, {cols}, kind || '_emoji' AS kind FROM {e} WHERE has_emoji)"

    def top(rel, lim):
        r = (f"SELECT run, kind, row_number() OVER (PARTITION BY run, kind ORDER BY "
             f"CASE WHEN kind LIKE 'fp%' THEN -p ELSE p END, id) AS rank, id, {cols} FROM {rel}")
        return f"SELECT * FROM ({r})" + (f" WHERE rank <= {lim}" if lim else "")

    return _w(f"{top(e, k)} UNION ALL {top(emo, k_emoji)}")


def _inputs(spark, sf):
    from mojiframe.operators.variants import add_variants

    return add_variants(T.corpus(spark, sf)).select("id", "x_text", "x_emoji")


@register("l1_sorted_errors", lambda: _ranked_sql(None, None))
def l1_sorted_errors(spark, sf):
    """Every error ranked: the full L1 ordering."""
    checkpoint_dir(spark)
    return ER.sorted_errors(preds(spark, sf), columns=_ERR_COLS, inputs=_inputs(spark, sf))


@register("l2_top_errors", lambda: _ranked_sql(50, 25))
def l2_top_errors(spark, sf):
    """R2: the four error tables of every run, top 50 / top 25 with emoji."""
    from mojiframe.operators.variants import add_variants

    def variants(df):  # of the few rows that are left
        return add_variants(df.drop("has_emoji")) if "has_emoji" in df.columns else add_variants(df)

    return ER.top_errors(preds(spark, sf), k=50, k_emoji=25, columns=_ERR_COLS, derive=variants,
                         inputs=T.corpus(spark, sf).select("id", "text"))


def _by_slice(spark, sf):
    return M.metrics_by_slice(preds(spark, sf))


_LB_SQL = """
SELECT w.run AS run_folder, r.fusion_mode, r.text_col AS text_col_used, test_macro_f1, test_accuracy,
       emoji_subset_f1, no_emoji_subset_f1
FROM (SELECT run,
             max(CASE WHEN slice = 'all' THEN macro_f1 END) AS test_macro_f1,
             max(CASE WHEN slice = 'all' THEN accuracy END) AS test_accuracy,
             max(CASE WHEN slice = 'emoji' THEN macro_f1 END) AS emoji_subset_f1,
             max(CASE WHEN slice = 'no_emoji' THEN macro_f1 END) AS no_emoji_subset_f1
      FROM ({by_slice}) GROUP BY run) w
JOIN ({runs}) r ON w.run = r.run
ORDER BY test_macro_f1 DESC NULLS LAST, run_folder"""


@register("r03_leaderboard", lambda: _w(_LB_SQL.format(by_slice=S.by_slice_sql(), runs=S.runs_sql())))
def r03_leaderboard(spark, sf):
    return R.leaderboard(_by_slice(spark, sf), RN.run_config(spark))


def _expected(spark):
    cfg = RN.run_config(spark).select("run")
    extra = spark.createDataFrame([(_name(*EXTRA_EXPECTED),)], "run string")
    return cfg.unionByName(extra)


def _expected_sql() -> str:
    return f"SELECT run FROM ({S.runs_sql()}) UNION ALL SELECT '{_name(*EXTRA_EXPECTED)}' AS run"


@register("r04_comparison_table", lambda: _w(
    f"SELECT e.run, CASE WHEN m.macro_f1 IS NULL THEN 'MISSING' ELSE printf('%.4f', m.macro_f1) END "
    f"AS macro_f1_fmt, CASE WHEN m.accuracy IS NULL THEN 'MISSING' ELSE printf('%.4f', m.accuracy) END "
    f"AS accuracy_fmt, coalesce(m.macro_f1, 0.0) AS macro_f1_or_0 "
    f"FROM ({_expected_sql()}) e LEFT JOIN ({_metrics_body()}) m ON e.run = m.run"))
def r04_comparison_table(spark, sf):
    return R.comparison_table(_expected(spark), M.compute_metrics(preds(spark, sf)))


@register("r05_emoji_subset_comparison", lambda: _w(
    f"SELECT run, n, accuracy, macro_f1 FROM ({_metrics_body(where=f'WHERE id IN ({_dev_emoji_ids_sql()})')})"))
def r05_emoji_subset_comparison(spark, sf):
    return M.metrics_on_subset(preds(spark, sf), dev_emoji_ids(spark, sf)).select("run", "n", "accuracy", "macro_f1")


@register("r06_emoji_impact", lambda: _w(
    f"SELECT both_right, a_only, b_only, both_wrong, unpaired, d.delta_macro_f1 FROM ("
    f"SELECT count_if(a = 1 AND b = 1) AS both_right, count_if(a = 1 AND b = 0) AS a_only, "
    f"count_if(a = 0 AND b = 1) AS b_only, count_if(a = 0 AND b = 0) AS both_wrong, "
    f"count_if(a IS NULL OR b IS NULL) AS unpaired FROM ("
    f"SELECT id, max(CASE WHEN run = '{RUN_A}' THEN CAST(y_true = y_pred AS INTEGER) END) AS a, "
    f"max(CASE WHEN run = '{RUN_B}' THEN CAST(y_true = y_pred AS INTEGER) END) AS b "
    f"FROM preds WHERE run IN ('{RUN_A}', '{RUN_B}') GROUP BY id)) c, ("
    f"SELECT max(CASE WHEN run = '{RUN_A}' THEN macro_f1 END) - max(CASE WHEN run = '{RUN_B}' THEN macro_f1 END) "
    f"AS delta_macro_f1 FROM ({_metrics_body()})) d"))
def r06_emoji_impact(spark, sf):
    p = preds(spark, sf)
    agree = R.run_pair_agreement(p, RUN_A, RUN_B)
    delta = R.metric_delta(M.compute_metrics(p), RUN_A, RUN_B).select("delta_macro_f1").scalar()
    return agree.withColumn("delta_macro_f1", delta)


@register("r08_chart_series", lambda: _w(
    "SELECT slice || ':' || metric AS series, run AS x, y FROM (" + S.by_slice_sql() + ") b, "
    "LATERAL (VALUES ('macro_f1', b.macro_f1), ('accuracy', b.accuracy), ('tn', CAST(b.tn AS DOUBLE)), "
    "('fp', CAST(b.fp AS DOUBLE)), ('fn', CAST(b.fn AS DOUBLE)), ('tp', CAST(b.tp AS DOUBLE))) AS t(metric, y)"))
def r08_chart_series(spark, sf):
    return R.chart_series(_by_slice(spark, sf))


@register("j4_config_metrics", lambda: _w(
    f"SELECT r.run, r.fusion_mode, r.text_col, m.macro_f1, m.accuracy FROM ({S.runs_sql()}) r "
    f"JOIN ({_metrics_body()}) m ON r.run = m.run"))
def j4_config_metrics(spark, sf):
    m = M.compute_metrics(preds(spark, sf))
    return RN.run_config(spark).join(m, "run").select("run", "fusion_mode", "text_col", "macro_f1", "accuracy")


@register("j7_missing_runs", lambda: _w(
    f"SELECT run FROM ({_expected_sql()}) e WHERE run NOT IN (SELECT DISTINCT run FROM preds)"))
def j7_missing_runs(spark, sf):
    return R.missing_runs(_expected(spark), preds(spark, sf))


@register("u2_union_runs", lambda: _w(
    f"SELECT run, 'all' AS slice, n, accuracy, macro_f1, NULL AS subset FROM ({_metrics_body()}) "
    f"UNION ALL SELECT run, NULL AS slice, n, accuracy, macro_f1, 'dev_emoji' AS subset FROM "
    f"({_metrics_body(where=f'WHERE id IN ({_dev_emoji_ids_sql()})')})"))
def u2_union_runs(spark, sf):
    p = preds(spark, sf)
    a = M.compute_metrics(p).select("run", F.lit("all").alias("slice"), "n", "accuracy", "macro_f1")
    b = M.metrics_on_subset(p, dev_emoji_ids(spark, sf)).select(
        "run", "n", "accuracy", "macro_f1", F.lit("dev_emoji").alias("subset"))
    return a.unionByName(b, allowMissingColumns=True)


@register("u3_subset_ids", lambda: f"WITH {S.lexicon_cte()} SELECT DISTINCT id FROM ({_dev_emoji_ids_sql()})")
def u3_subset_ids(spark, sf):
    return dev_emoji_ids(spark, sf).distinct()


@register("g23_emoji_frequency", lambda: (
    f"SELECT emoji, count(*) AS n, count(DISTINCT id) AS n_texts FROM ("
    f"SELECT id, unnest(regexp_extract_all(text, {S.q('(' + S.TX.EMOJI + ')')}, 1)) AS emoji "
    f"FROM ({S.documents_emoji_sql()})) GROUP BY emoji"))
def g23_emoji_frequency(spark, sf):
    return R.emoji_frequency(T.documents_emoji(spark, sf))


@register("g23_emoji_sequence_frequency", lambda: (
    f"SELECT emoji, count(*) AS n, count(DISTINCT id) AS n_texts FROM ("
    f"SELECT id, unnest(regexp_extract_all(text, {S.q('(' + S.TX.SEQ + ')')}, 1)) AS emoji "
    f"FROM ({S.documents_emoji_sql()})) GROUP BY emoji"))
def g23_emoji_sequence_frequency(spark, sf):
    return R.emoji_frequency(T.documents_emoji(spark, sf), sequences=True)


@register("k10_run_names", lambda: _w(
    "SELECT run, regexp_extract(run, '^(text_only|emoji_only|concat|gated)_', 1) AS fusion_mode, regexp_extract(run, '_(x_[a-z]+)_roberta', 1) AS text_col, "
    "CAST(regexp_extract(run, '_lr([^_]+)_', 1) AS DOUBLE) AS lr, CAST(regexp_extract(run, '_ep([0-9]+)_', 1) AS INTEGER) AS epochs, "
    "CAST(regexp_extract(run, '_bs([0-9]+)_', 1) AS INTEGER) AS batch_size, CAST(regexp_extract(run, '_seed([0-9]+)$', 1) AS INTEGER) AS seed, "
    "true AS same, count(*) AS n, CAST(sum(y_pred) AS BIGINT) AS n_positive FROM preds GROUP BY run"))
def k10_run_names(spark, sf):
    """The names of the runs with predictions, read back into fields, built again from them, and their rows."""
    runs = preds(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_pred").cast("long")).alias("n_positive"))
    f = lambda k: F.col("f")[k]
    fields = ("fusion_mode", "text_col", "lr", "epochs", "batch_size", "seed")
    again = RN.make_run_name(f("fusion_mode"), f("text_col"), f("lr"), f("epochs"), f("batch_size"), f("seed"))
    return runs.withColumn("f", RN.run_name_fields(F.col("run"))).select(
        "run", *[f(k).alias(k) for k in fields], (again == F.col("run")).alias("same"), "n", "n_positive")


def _s08_sql() -> str:
    # a run of every arm and fold of the corpus; folds are seeds
    name = "replace(run, '_seed43', '_seed' || CAST(42 + id % 3 AS VARCHAR))"
    return _w(f"SELECT {name} AS run, 42 + CAST(any_value(id % 3) AS INTEGER) AS seed, count(*) AS n FROM preds "
              f"WHERE id % 3 <> 0 AND run NOT LIKE 'concat%' AND (run NOT LIKE 'gated%' OR id % 3 <> 1) GROUP BY {name} "
              f"HAVING seed = 43 OR seed = 44 ORDER BY run")


@register("s08_discover_runs", _s08_sql)
def s08_discover_runs(spark, sf):
    """Predictions of every arm and fold (id modulo 3, as seeds 42 to 44) are stored through the
    commit log, with a config document a run; runs of ``concat`` have underscored folders, ``gated`` of seed 43 has
    rows that were staged but never committed, and ``missing`` has a config without rows.  Those left of seeds 43 and 44, with their rows."""
    from mojiframe.sources import io as IO
    from mojiframe.sources import runlog

    root = f"{checkpoint_dir(spark).rstrip('/')}/discovery-{uuid.uuid4().hex}"
    seed = F.pmod("id", F.lit(3)).cast("int") + 42
    p = preds(spark, sf).select(F.regexp_replace("run", "_seed43$", F.concat(F.lit("_seed"), seed.cast("string"))).alias("run"), "id", "y_true", "y_pred", "p")
    p = p.withColumn("run", F.when(F.col("run").startswith("concat"), F.concat(F.lit("_"), "run")).otherwise(F.col("run")))
    lost = F.col("run").startswith("gated") & F.col("run").endswith("seed43")
    IO.write_predictions(p.where(~lost), f"{root}/predictions")
    runlog.stage(p.where(lost), f"{root}/predictions")
    cfg = p.select("run").distinct().union(spark.createDataFrame([("missing",)], "run string"))
    number = F.coalesce(F.regexp_extract("run", r"_seed(\d+)$", 1).try_cast("int"), F.lit(43))
    doc = F.to_json(F.struct(F.col("run").alias("run_name"), F.lit("gated").alias("fusion_mode"), number.alias("seed")))
    cfg.select(F.col("run").alias("run_folder"), doc.alias("value")).write.partitionBy("run_folder").text(f"{root}/configs")
    found = [RN.discover_stored_runs(spark, f"{root}/predictions", f"{root}/configs", only_seed=s).select("run", "seed") for s in (43, 44)]
    rows = IO.read_predictions(spark, f"{root}/predictions").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return found[0].union(found[1]).join(rows, "run").select("run", "seed", "n").orderBy("run")


def _s09_sql() -> str:
    from mojiframe.plans.q_eval import _train_sql
    from mojiframe.sources.runs import SHARED

    return (f"SELECT r.run, '{SHARED['pretrained']}' AS pretrained, r.fusion_mode, r.text_col, '{SHARED['emoji_col']}' AS emoji_col, "
            f"{SHARED['max_len']} AS max_len, {SHARED['batch_size']} AS batch_size, CAST({SHARED['lr']!r} AS DOUBLE) AS lr, "
            f"{SHARED['epochs']} AS epochs, {SHARED['seed']} AS seed, n0, n1, 0 AS n_unknown FROM ({S.runs_sql()}) r, "
            f"(SELECT count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM ({_train_sql()})) c")


@register("s09_config_roundtrip", _s09_sql)
def s09_config_roundtrip(spark, sf):
    """K5 + S9: per-run config documents (with the train label counts of the data), of the odd runs as
    JSON and of the even ones as flat YAML, a file each, read and parsed into typed columns."""
    from mojiframe.plans.q_eval import train_rows

    counts = train_rows(spark, sf).agg(F.count_if(F.col("label") == 0).alias("n0"),
                                       F.count_if(F.col("label") == 1).alias("n1"))
    n0, n1 = counts.select("n0").scalar(), counts.select("n1").scalar()
    lr, labels = F.format_string("%.0e", "lr"), F.create_map(F.lit("0"), n0, F.lit("1"), n1)
    cfg = RN.run_config(spark)
    as_json = F.to_json(F.struct(F.col("run").alias("run_name"), "pretrained", "fusion_mode", "text_col", "emoji_col", "max_len", "batch_size",
                                 lr.alias("lr"), "epochs", "seed", labels.alias("train_label_counts")))
    lines = [F.lit("# a run"), F.concat(F.lit('run_name: "'), "run", F.lit('"')), F.concat(F.lit("pretrained_name: "), "pretrained")]
    lines += [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("fusion_mode", "text_col", "emoji_col", "max_len", "batch_size", "epochs", "seed")]
    lines += [F.concat(F.lit("lr: "), lr, F.lit("  # rate")), F.concat(F.lit("train_label_counts: "), F.to_json(labels))]
    raw = cfg.select("run_no", F.when(F.col("run_no") % 2 == 1, as_json).otherwise(F.array_join(F.array(*lines), "\n")).alias("value"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/run_configs-{uuid.uuid4().hex}"
    raw.write.partitionBy("run_no").text(path)
    parsed = RN.read_configs(spark, path)
    return parsed.select("run", "pretrained", "fusion_mode", "text_col", "emoji_col", "max_len", "batch_size", "lr", "epochs", "seed",
                         F.col("train_label_counts")["0"].alias("n0"), F.col("train_label_counts")["1"].alias("n1"),
                         F.size("unknown_fields").alias("n_unknown"))
