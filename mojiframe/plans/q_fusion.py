"""Registered fusion queries (M6-M14) over the embeddings table."""

from __future__ import annotations


from pyspark.sql import functions as F

from mojiframe.operators import fusion as FU
from mojiframe.operators import metrics as M
from mojiframe.plans import sqltext as S
from mojiframe.plans.catalog import register
from mojiframe.sources import tables as T

DIM = 64
P = FU.fusion_params(DIM)


def pairs(spark, sf):
    return FU.embedding_pairs(T.read_table(spark, sf, "embeddings"))


def fused(spark, sf, mode):
    return FU.fuse(pairs(spark, sf), mode, DIM, P)


# --- SQL mirror ----------------------------------------------------------------
def _arr(xs) -> str:
    return "(CAST([" + ", ".join(repr(float(x)) for x in xs) + "] AS DOUBLE[]))"


def _mat(rows) -> str:
    return "(CAST([" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in rows) + "] AS DOUBLE[][]))"


def _dot(a: str, b: str, v: str = "i") -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda {v}: {a}[{v}] * {b}[{v}]), "
            f"lambda x, y: x + y)")


def _sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def _pairs_sql() -> str:
    return ("SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS t, CAST(coalesce(b.embedding, a.embedding) AS DOUBLE[]) AS e, "
            "CAST(a.vec_id % 7 <> 6 AS INTEGER) AS emoji_present, CAST(a.label % 2 AS INTEGER) AS y_true "
            "FROM embeddings a LEFT JOIN embeddings b ON (a.vec_id + 1) % (SELECT count(*) FROM embeddings) = b.vec_id")


def _mix(g: str, per_unit: bool) -> str:
    gi = f"{g}[k]" if per_unit else g
    return f"list_transform(range(1, {DIM} + 1), lambda k: {gi} * t[k] + (1.0 - {gi}) * e[k])"


def _fused_sql(mode: str) -> str:
    """SELECT vec_id, y_true, emoji_present, gate, h over the pairs."""
    if mode == "text_only":
        h, gate = "t", "CAST(NULL AS DOUBLE)"
    elif mode == "emoji_only":
        h, gate = "e", "CAST(NULL AS DOUBLE)"
    elif mode == "concat":
        h, gate = "list_concat(t, e)", "CAST(NULL AS DOUBLE)"
    elif mode == "gated":
        gate = _sig(_dot(_arr(P["gate_w"]), "list_concat(t, e)") + f" + {P['gate_b']!r}")
        return (f"SELECT vec_id, y_true, emoji_present, gate, {_mix('gate', False)} AS h FROM "
                f"(SELECT *, {gate} AS gate FROM ({_pairs_sql()}))")
    else:
        g = (f"list_transform({_mat(P['vgate_W'])}, lambda r, j: "
             f"{_sig(_dot('r', 'list_concat(t, e)', 'q') + ' + ' + _arr(P['vgate_b']) + '[j]')})")
        if mode == "gated_vector_masked":
            g = f"CASE WHEN emoji_present = 0 THEN list_transform(range(1, {DIM} + 1), lambda z: 1.0) ELSE {g} END"
        return (f"SELECT vec_id, y_true, emoji_present, "
                f"list_reduce(g, lambda x, y: x + y) / {float(DIM)!r} AS gate, {_mix('g', True)} AS h FROM "
                f"(SELECT *, {g} AS g FROM ({_pairs_sql()}))")
    return f"SELECT vec_id, y_true, emoji_present, {gate} AS gate, {h} AS h FROM ({_pairs_sql()})"


def _scored_sql(mode: str) -> str:
    d = 2 * DIM if mode == "concat" else DIM
    W, b = P["head"][d]
    l0 = f"({_dot(_arr(W[0]), 'h')} + {b[0]!r})"
    l1 = f"({_dot(_arr(W[1]), 'h')} + {b[1]!r})"
    return (f"SELECT *, exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p, "
            f"CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS y_pred, '{mode}' AS mode FROM "
            f"(SELECT *, {l0} AS l0, {l1} AS l1 FROM ({_fused_sql(mode)}))")


def _rounded(mode: str):
    def sql():
        return (f"SELECT vec_id, round(gate, 6) AS gate, round(p, 6) AS p, y_pred "
                f"FROM ({_scored_sql(mode)})")
    return sql


def _rounded_spark(spark, sf, mode):
    return fused(spark, sf, mode).select("vec_id", F.round("gate", 6).alias("gate"),
                                         F.round("p", 6).alias("p"), "y_pred")


@register("m08_first_token_pooling", lambda: (
    "SELECT vec_id // 5 AS sequence, arg_min(embedding, vec_id * 3 % 5) AS pooled FROM embeddings GROUP BY vec_id // 5"))
def m08_first_token_pooling(spark, sf):
    """M8: five vectors make a sequence; their positions are not in the order of their ids."""
    t = T.read_table(spark, sf, "embeddings")
    tokens = t.select(F.floor(F.col("vec_id") / 5).alias("sequence"), F.pmod(F.col("vec_id") * 3, F.lit(5)).alias("position"), "embedding")
    return FU.first_token(tokens, "sequence", "position", "embedding")


@register("m09_gated_fusion", _rounded("gated"))
def m09_gated_fusion(spark, sf):
    return _rounded_spark(spark, sf, "gated")


@register("m10_vector_gate", _rounded("gated_vector"))
def m10_vector_gate(spark, sf):
    return _rounded_spark(spark, sf, "gated_vector")


@register("m11_masked_vector_gate", _rounded("gated_vector_masked"))
def m11_masked_vector_gate(spark, sf):
    return _rounded_spark(spark, sf, "gated_vector_masked")


@register("m12_concat_fusion", _rounded("concat"))
def m12_concat_fusion(spark, sf):
    return _rounded_spark(spark, sf, "concat")


@register("m14_classifier_head", lambda: (
    f"SELECT vec_id, round(l0, 6) AS l0, round(l1, 6) AS l1 FROM ({_scored_sql('text_only')})"))
def m14_classifier_head(spark, sf):
    f = fused(spark, sf, "text_only")
    return f.select("vec_id", F.round(F.element_at("logits", 1), 6).alias("l0"),
                    F.round(F.element_at("logits", 2), 6).alias("l1"))


@register("m07_softmax", lambda: f"SELECT vec_id, round(p, 6) AS p FROM ({_scored_sql('emoji_only')})")
def m07_softmax(spark, sf):
    return fused(spark, sf, "emoji_only").select("vec_id", F.round("p", 6).alias("p"))


@register("m06_argmax", lambda: f"SELECT vec_id, y_pred FROM ({_scored_sql('text_only')})")
def m06_argmax(spark, sf):
    return fused(spark, sf, "text_only").select("vec_id", "y_pred")


@register("m05_threshold", lambda: (
    f"SELECT vec_id, CAST(p >= 0.5 AS INTEGER) AS y_pred_threshold, y_pred FROM ({_scored_sql('concat')})"))
def m05_threshold(spark, sf):
    f = fused(spark, sf, "concat")
    return f.select("vec_id", (F.col("p") >= 0.5).cast("int").alias("y_pred_threshold"), "y_pred")


@register("m13_fusion_modes", lambda: (
    "SELECT mode, n, tn, fp, fn, tp, " + S.metrics_sql() + " FROM (SELECT mode, " + S.CONFUSION_SQL +
    " FROM (" + " UNION ALL ".join(f"SELECT mode, y_true, y_pred FROM ({_scored_sql(m)})" for m in FU.MODES) +
    ") GROUP BY mode)"))
def m13_fusion_modes(spark, sf):
    """Every fusion mode scored and evaluated against the labels, one query."""
    return M.compute_metrics(FU.fuse_all(pairs(spark, sf), DIM, P), ["mode"])
