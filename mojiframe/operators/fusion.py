"""Fusion of text and emoji embeddings on array columns.

Inference-time arithmetic of the fusion models, written with array
higher-order functions so it runs row-local in the JVM: pooling, scalar and
vector gates (optionally masked when a text has no emoji), concatenation,
a two-logit linear head, softmax and argmax.  Weights are
data: a one-row table read as a scalar, so the plan does not grow with the
dimension; ``rule_weights`` makes a reproducible set from
a seed for tests and the registered queries.  Dot products are sequential
left folds, so every engine sums in the same order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("text_only", "emoji_only", "concat", "gated", "gated_vector", "gated_vector_masked")


def rule_weights(n: int, seed: int) -> list[float]:
    """``n`` weights in [-0.09, 0.09] from an integer rule (no RNG state)."""
    return [(((i * 37 + seed * 11) % 19) - 9) / 100.0 for i in range(n)]


def weights(spark: SparkSession, **values) -> Column:
    """A struct of weight vectors and matrices, from a table of one row."""
    kind = lambda v: "double" if not isinstance(v, list) else f"array<{kind(v[0])}>"
    ddl = ", ".join(f"{k} {kind(v)}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(F.struct(*values)).scalar()


def as_double_array(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def first_token(tokens: DataFrame, sequence: str, position: str, vector: str, out: str = "pooled") -> DataFrame:
    """M8: the pooled vector of a sequence is that of its first token.  Tokens are rows
    ``(sequence, position, vector)``; partial aggregates keep one vector a sequence and task."""
    return tokens.groupBy(sequence).agg(F.min_by(vector, position).alias(out))


def mix(g: Column, ht: Column, he: Column, dim: int, per_unit: bool = False) -> Column:
    """``g * ht + (1 - g) * he`` for a scalar gate, or a gate array when
    ``per_unit``."""
    def at(i):
        gi = F.element_at(g, i) if per_unit else g
        return gi * F.element_at(ht, i) + (F.lit(1.0) - gi) * F.element_at(he, i)
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), at)


def scalar_gate(hh: Column, w: Column, b: Column) -> Column:
    """M9: ``sigmoid(w . hh + b)`` with ``hh = [ht; he]``."""
    return sigmoid(dot(w, hh) + b)


def vector_gate(hh: Column, W: Column, b: Column, emoji_present: Column | None = None) -> Column:
    """One gate per hidden unit from ``hh = [ht; he]`` (pass column
    references: every unit reads them); with ``emoji_present`` = 0 the gate is 1
    (text only)."""
    g = F.transform(W, lambda r, j: sigmoid(dot(r, hh) + F.element_at(b, j + 1)))
    # dimension guard (NULL on mismatch)
    g = F.when(F.size(hh) == F.size(F.element_at(W, 1)), g)
    if emoji_present is not None:
        g = F.when(emoji_present == 0, F.transform(b, lambda _: F.lit(1.0))).otherwise(g)
    return g


def head(h: Column, W: Column, b: Column) -> Column:
    """Two logits ``W h + b``."""
    return F.transform(W, lambda r, k: dot(r, h) + F.element_at(b, k + 1))


def softmax_p1(logits: Column) -> Column:
    """M7: softmax probability of class 1 (max-shifted)."""
    m = F.array_max(logits)
    e0 = F.exp(F.element_at(logits, 1) - m)
    e1 = F.exp(F.element_at(logits, 2) - m)
    return e1 / (e0 + e1)


def argmax(logits: Column) -> Column:
    """M6: index of the first maximum (ties -> class 0)."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def fusion_params(dim: int, seed: int = 7) -> dict:
    return {
        "gate_w": rule_weights(2 * dim, seed), "gate_b": 0.01,
        "vgate_W": [rule_weights(2 * dim, seed + 1 + j) for j in range(dim)],
        "vgate_b": rule_weights(dim, seed + 100),
        "head": {d: ([rule_weights(d, seed + 200), rule_weights(d, seed + 300)], [0.02, -0.02])
                 for d in (dim, 2 * dim)},
    }


def fuse(pairs: DataFrame, mode: str, dim: int, params: dict | None = None,
         ht: str = "h_text", he: str = "h_emoji", present: str = "emoji_present") -> DataFrame:
    """One fusion mode -> ``h`` (and ``gate`` where there is one),
    ``logits``, ``p`` and ``y_pred``.  Unknown modes raise."""
    if mode not in MODES:
        raise ValueError(f"Unknown fusion mode: {mode!r}")
    P = params or fusion_params(dim)
    d = 2 * dim if mode == "concat" else dim
    W, b = P["head"][d]
    own = {"hW": W, "hb": b}
    if mode == "gated":
        own |= {"gw": P["gate_w"], "gb": P["gate_b"]}
    elif mode.startswith("gated"):
        own |= {"vW": P["vgate_W"], "vb": P["vgate_b"]}
    # materialise the double vectors once: lambdas below read them per unit
    pairs = pairs.select("*", as_double_array(ht).alias("__t"), as_double_array(he).alias("__e"), weights(pairs.sparkSession, **own).alias("__w"))
    w = F.col("__w")
    pairs = pairs.select("*", F.concat("__t", "__e").alias("__hh"))
    t, e, hh = F.col("__t"), F.col("__e"), F.col("__hh")
    no_gate = F.lit(None).cast("double")
    if mode in ("text_only", "emoji_only", "concat"):
        h = {"text_only": t, "emoji_only": e, "concat": F.concat(t, e)}[mode]
        base = pairs.select("*", no_gate.alias("gate"), h.alias("h"))
    elif mode == "gated":
        # the gate is materialised once, then read by every unit of the mix
        base = pairs.select("*", scalar_gate(hh, w["gw"], w["gb"]).alias("gate"))
        base = base.withColumn("h", mix(F.col("gate"), t, e, dim))
    else:
        g = vector_gate(hh, w["vW"], w["vb"],
                        F.col(present) if mode == "gated_vector_masked" else None)
        base = pairs.select("*", g.alias("g"))
        base = base.select("*", (F.aggregate("g", F.lit(0.0), lambda acc, x: acc + x)
                                 / F.lit(float(dim))).alias("gate"),
                           mix(F.col("g"), t, e, dim, per_unit=True).alias("h"))
    out = base.withColumn("logits", head(F.col("h"), w["hW"], w["hb"])).drop("__t", "__e", "__hh", "__w")
    return out.select("*", softmax_p1(F.col("logits")).alias("p"), argmax(F.col("logits")).alias("y_pred"),
                      F.lit(mode).alias("mode"))


def fuse_all(pairs: DataFrame, dim: int, params: dict | None = None) -> DataFrame:
    """Every mode on the same rows: ``(vec_id, y_true, mode, y_pred)``.  The pairs are
    made once; each mode adds its decision as a column, and the columns become rows."""
    keep, out = list(pairs.columns), pairs
    for i, mode in enumerate(MODES):
        out = fuse(out, mode, dim, params).withColumnRenamed("y_pred", f"y_{i}").select(*keep, f"y_{i}")
        keep.append(f"y_{i}")
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"y_{i}").alias("y_pred")) for i, m in enumerate(MODES)])
    return out.select("vec_id", "y_true", F.inline(each))


def embedding_pairs(emb: DataFrame) -> DataFrame:
    """``(vec_id, h_text, h_emoji, emoji_present, y_true)``: each vector is
    paired with the next one (cyclic) as its emoji vector - an equi-join on
    a computed key, the row count n coming from a scalar subquery.  Where the ids
    have a gap and there is no next one, a vector is its own partner: no row is lost."""
    n = emb.agg(F.count(F.lit(1))).scalar()
    a = emb.select("vec_id", F.col("embedding").alias("h_text"), "label",
                   F.pmod(F.col("vec_id") + 1, n).alias("partner"))
    b = emb.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("h_emoji"))
    return a.join(b, "partner", "left").select(
        "vec_id", "h_text", F.coalesce("h_emoji", "h_text").alias("h_emoji"),
        (F.pmod(F.col("vec_id"), F.lit(7)) != 6).cast("int").alias("emoji_present"),
        F.pmod(F.col("label"), F.lit(2)).cast("int").alias("y_true"))
