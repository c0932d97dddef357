"""Registered split queries (SP1-SP3, J1, J5, G10-G13, R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mojiframe.operators import reports as R
from mojiframe.operators import splits as SP
from mojiframe.operators.variants import add_variants
from mojiframe.plans import sqltext as S
from mojiframe.plans.catalog import register
from mojiframe.sources import tables as T

DEV_SIZE, SEED = 0.15, 42


def corpus_variants(spark, sf):
    return add_variants(T.corpus(spark, sf))


def split_of(spark, sf, keep=()):
    return SP.stratified_split(corpus_variants(spark, sf), DEV_SIZE, SEED, keep=keep)


def _cv_split_sql() -> str:
    """SQL relation: corpus variants with their split (needs lexm)."""
    return (f"SELECT cv.*, s.split FROM ({S.corpus_variants_sql()}) cv "
            f"JOIN {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)} s ON cv.id = s.id")


@register("sp1_stratified_split", lambda: f"SELECT * FROM {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)}")
def sp1_stratified_split(spark, sf):
    return SP.stratified_split(T.corpus(spark, sf), DEV_SIZE, SEED)


@register("sp2_sample_split", lambda: (
    f"SELECT id, label, CASE WHEN substr(md5(concat_ws('-', '{SEED}', CAST(id AS VARCHAR))), 1, 8) < "
    f"'{int(DEV_SIZE * 2 ** 32):08x}' THEN 'dev' ELSE 'train' END AS split FROM ({S.corpus_sql()})"))
def sp2_sample_split(spark, sf):
    return SP.sample_split(T.corpus(spark, sf), DEV_SIZE, SEED)


@register("sp3_split_sanity", lambda: (
    f"WITH s AS (SELECT * FROM {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)}), "
    f"per AS (SELECT id, count_if(split = 'train') AS t, count_if(split = 'dev') AS d FROM s GROUP BY id), "
    f"u AS (SELECT DISTINCT id, true AS in_universe FROM ({S.corpus_sql()})), "
    f"j AS (SELECT * FROM per FULL JOIN u USING (id)) "
    f"SELECT CAST(coalesce(sum(t), 0) AS BIGINT) AS n_train, CAST(coalesce(sum(d), 0) AS BIGINT) AS n_dev, "
    f"count_if(t > 0 AND d > 0) AS overlap, count_if(t + d > 1) AS duplicated, "
    f"count_if(t IS NULL) AS missing, count_if(in_universe IS NULL) AS unknown FROM j"))
def sp3_split_sanity(spark, sf):
    c = T.corpus(spark, sf)
    return SP.split_sanity(SP.stratified_split(c, DEV_SIZE, SEED), c)


@register("j1_dev_rows", lambda: (
    f"SELECT c.id, c.label, c.rephrase FROM ({S.corpus_sql()}) c "
    f"WHERE c.id IN (SELECT id FROM {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)} WHERE split = 'dev')"))
def j1_dev_rows(spark, sf):
    c = T.corpus(spark, sf)
    return SP.select_split(c, SP.stratified_split(c, DEV_SIZE, SEED), "dev").select("id", "label", "rephrase")


@register("j5_split_overlap", lambda: (
    f"WITH s AS (SELECT * FROM {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)}) "
    f"SELECT count(*) AS overlap FROM (SELECT id FROM s WHERE split = 'train') t "
    f"WHERE t.id IN (SELECT id FROM s WHERE split = 'dev')"))
def j5_split_overlap(spark, sf):
    s = SP.stratified_split(T.corpus(spark, sf), DEV_SIZE, SEED)
    tr = s.where(F.col("split") == "train").select("id")
    dv = s.where(F.col("split") == "dev").select("id")
    return tr.join(dv, "id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


_STATS_SQL = """
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split,
       count(*) AS n,
       round(avg(CAST(has_emoji AS INTEGER)), 3) AS emoji_rate,
       round(avg(CAST(label AS DOUBLE)), 3) AS positive_rate,
       count_if(label = 0) AS n_label0, count_if(label = 1) AS n_label1,
       count(rephrase) AS n_rephrase
FROM ({rel}) GROUP BY ROLLUP (split)"""


@register("r07_corpus_stats", lambda: S.with_ctes(S.lexicon_cte(), body=_STATS_SQL.format(rel=_cv_split_sql())))
def r07_corpus_stats(spark, sf):
    return R.corpus_stats(split_of(spark, sf, keep=["has_emoji", "rephrase"]))


@register("g10_rows_by_split", lambda: (
    f"SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS n "
    f"FROM {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)} GROUP BY ROLLUP (split)"))
def g10_rows_by_split(spark, sf):
    s = SP.stratified_split(T.corpus(spark, sf), DEV_SIZE, SEED)
    g = s.rollup("split").agg(F.count(F.lit(1)).alias("n"), F.grouping("split").alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "n")


@register("g11_emoji_rate", lambda: S.with_ctes(S.lexicon_cte(), body=(
    f"SELECT avg(CAST(has_emoji AS INTEGER)) AS emoji_rate FROM ({S.corpus_variants_sql()})")))
def g11_emoji_rate(spark, sf):
    return corpus_variants(spark, sf).agg(F.avg(F.col("has_emoji").cast("int")).alias("emoji_rate"))


@register("g12_label_counts", lambda: (
    f"SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share "
    f"FROM ({S.corpus_sql()}) GROUP BY label"))
def g12_label_counts(spark, sf):
    from pyspark.sql import Window

    g = T.corpus(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@register("g13_rephrase_count", lambda: (
    f"SELECT split, count(rephrase) AS n_rephrase FROM ({S.corpus_sql()}) c "
    f"JOIN {S.split_sql(S.corpus_sql(), DEV_SIZE, SEED)} s ON c.id = s.id GROUP BY split"))
def g13_rephrase_count(spark, sf):
    s = SP.stratified_split(T.corpus(spark, sf), DEV_SIZE, SEED, keep=["rephrase"])
    return s.groupBy("split").agg(F.count("rephrase").alias("n_rephrase"))
