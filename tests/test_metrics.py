"""Golden metrics from the reference's stored confusion matrices."""

import pytest
from pyspark.sql import functions as F

from mojiframe.operators import metrics as M

# run, slice, tn, fp, fn, tp, macro_f1, accuracy
GOLDEN = [
    ("lr_tfidf_text", "dev", 324, 67, 91, 39, 0.567239, 0.696737),
    ("lr_tfidf_demojized_proc", "dev", 325, 66, 91, 39, 0.568684, 0.698656),
    ("roberta_text_only", "dev", 352, 39, 93, 37, 0.600664, 0.746641),
    ("roberta_full", "dev", 359, 32, 95, 35, 0.602517, 0.756238),
    ("gated_fusion", "dev", 368, 23, 101, 29, 0.587248, 0.761996),
    ("concat_x_text", "dev", 391, 0, 130, 0, 0.428728, 0.750480),
    ("emoji_only_x_text", "test_emoji", 0, 283, 0, 18, 0.056426, 0.059801),
    ("text_only_x_full", "test_all", 988, 212, 94, 106, 0.637587, 0.781429),
]
# per emoji slice of the test set: (tn, fp, fn, tp) for emoji and no-emoji rows
SLICES = {
    "text_only_x_full": ((224, 59, 5, 13), (764, 153, 89, 93), 0.637587, 0.581944, 0.648928),
    "concat_x_text": ((283, 0, 18, 0), (917, 0, 182, 0), 0.461538, 0.484589, 0.454861),
    "emoji_only_x_text": ((0, 283, 0, 18), (917, 0, 182, 0), 0.434797, 0.056426, 0.454861),
}


def expand(spark, rows):
    """(run, has_emoji, tn, fp, fn, tp) -> one prediction row per counted cell."""
    df = spark.createDataFrame(rows, "run string, has_emoji boolean, tn int, fp int, fn int, tp int")
    cells = df.select("run", "has_emoji", F.expr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp)").alias("y_true", "y_pred", "cnt"))
    return cells.select("run", "has_emoji", "y_true", "y_pred",
                        F.explode(F.sequence(F.lit(1), F.col("cnt"))).alias("k")).where("cnt > 0")


def test_golden_metrics(spark):
    rows = [(r[0] + ":" + r[1], True, *r[2:6]) for r in GOLDEN]
    out = {r.run: r for r in M.compute_metrics(expand(spark, rows), ["run"]).collect()}
    for run, sl, tn, fp, fn, tp, f1, acc in GOLDEN:
        r = out[run + ":" + sl]
        assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp)
        assert r.n == tn + fp + fn + tp
        assert round(r.macro_f1, 6) == pytest.approx(f1, abs=1e-6)
        assert round(r.accuracy, 6) == pytest.approx(acc, abs=1e-6)


def test_golden_slices_and_error_summary(spark):
    rows = []
    for run, (emo, no, *_rest) in SLICES.items():
        rows.append((run, True, *emo))
        rows.append((run, False, *no))
    preds = expand(spark, rows)
    by = {(r.run, r.slice): r for r in M.metrics_by_slice(preds).collect()}
    for run, (_e, _n, f_all, f_emo, f_no) in SLICES.items():
        assert round(by[(run, "all")].macro_f1, 6) == pytest.approx(f_all, abs=1e-6)
        assert round(by[(run, "emoji")].macro_f1, 6) == pytest.approx(f_emo, abs=1e-6)
        assert round(by[(run, "no_emoji")].macro_f1, 6) == pytest.approx(f_no, abs=1e-6)
    es = {r.run: r for r in M.error_summary(preds).collect()}
    assert (es["text_only_x_full"].fp_count, es["text_only_x_full"].fn_count) == (212, 94)
    assert (es["text_only_x_full"].fp_emoji_rate, es["text_only_x_full"].fn_emoji_rate) == (0.278, 0.053)
    assert (es["concat_x_text"].fp_emoji_rate, es["concat_x_text"].fn_emoji_rate) == (0.0, 0.09)
    assert (es["emoji_only_x_text"].fp_emoji_rate, es["emoji_only_x_text"].fn_emoji_rate) == (1.0, 0.0)


def test_empty_slice_has_no_row(spark):
    preds = expand(spark, [("r", True, 3, 1, 0, 2)])
    slices = {r.slice for r in M.metrics_by_slice(preds).collect()}
    assert slices == {"all", "emoji"}


def test_class_weight(spark):
    df = spark.createDataFrame([(0,)] * 2210 + [(1,)] * 737, "label int")
    r = M.class_weight_w1(df).collect()[0]
    assert (r.n0, r.n1, r.w0) == (2210, 737, 1.0) and r.w1 == pytest.approx(2210 / 737)


def _fold(scores, tol=1e-6, patience=None):
    best, best_e, bad, stop = -1e300, None, 0, None
    for e, s in scores:
        if stop is not None:
            break
        if s > best + tol:
            best, best_e, bad = s, e, 0
        else:
            bad += 1
            if patience is not None and bad >= patience:
                stop = e
    return best_e, stop


@pytest.mark.parametrize("seed", range(6))
def test_best_epoch_matches_running_rule(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = []
    truth = {}
    for run in range(5):
        scores = [(e, round(rnd.random(), 2)) for e in range(1, rnd.randint(2, 8))]
        rnd.shuffle(scores)
        rows += [(f"r{run}", e, s) for e, s in scores]
        truth[f"r{run}"] = (_fold(sorted(scores)), _fold(sorted(scores), patience=2))
    df = spark.createDataFrame(rows, "run string, epoch int, macro_f1 double")
    plain = {r.run: (r.best_epoch, r.stop_epoch) for r in M.best_epoch(df).collect()}
    pat = {r.run: (r.best_epoch, r.stop_epoch) for r in M.best_epoch(df, patience=2).collect()}
    for run, (t_plain, t_pat) in truth.items():
        assert plain[run] == t_plain
        assert pat[run] == t_pat
