"""Stratified split: exact quotas, scalable form == window form, sanity."""

from pyspark.sql import functions as F

from conftest import SF01
from mojiframe.operators import splits as SP
from mojiframe.sources import tables as T


def test_reference_quotas(spark):
    # 2601 negatives, 867 positives, 15 % dev -> 391 / 130 (reference stats)
    df = spark.range(3468).select(F.col("id"), (F.col("id") >= 2601).cast("int").alias("label"))
    s = SP.stratified_split(df, 0.15, 42)
    got = {(r.split, r.label): r["count"] for r in s.groupBy("split", "label").count().collect()}
    assert got == {("dev", 0): 391, ("dev", 1): 130, ("train", 0): 2210, ("train", 1): 737}


def test_scalable_equals_window_form(spark):
    df = spark.range(20000).select("id", (F.pmod(F.col("id") * 7, 5) == 0).cast("int").alias("label"))
    a = SP.stratified_split(df, 0.2, 7)
    b = SP.stratified_split_window(df, 0.2, 7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stable_under_repartition(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    a = SP.stratified_split(df.repartition(1), 0.15, 42)
    b = SP.stratified_split(df.repartition(13), 0.15, 42)
    assert a.exceptAll(b).count() == 0


def test_split_on_corpus_is_sane(spark):
    c = T.corpus(spark, SF01)
    s = SP.stratified_split(c, 0.15, 42)
    r = SP.split_sanity(s, c).collect()[0]
    assert (r.overlap, r.duplicated, r.missing, r.unknown) == (0, 0, 0, 0)
    n = c.count()
    assert r.n_train + r.n_dev == n
    assert r.n_dev == -(-15 * n // 100)  # ceil(0.15 n)


def test_keep_columns_ride_along(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("label"),
                                 F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    s = SP.stratified_split(df, 0.1, 1, keep=["text"])
    assert s.where(F.col("text") != F.concat(F.lit("t"), F.col("id").cast("string"))).count() == 0


def test_hot_label_split_is_exact(spark):
    # one label holds all rows but three: quotas stay exact and the result
    # equals the window form, with no window over the hot class
    df = spark.range(30000).select("id", (F.col("id") < 3).cast("int").alias("label"))
    a = SP.stratified_split(df, 0.15, 9)
    b = SP.stratified_split_window(df, 0.15, 9)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    got = {(r.split, r.label): r["count"] for r in a.groupBy("split", "label").count().collect()}
    assert got[("dev", 0)] + got.get(("dev", 1), 0) == 4500
    import re

    plan = a._jdf.queryExecution().optimizedPlan().toString()
    # the only row ranking partitioned by label is the boundary-bucket one
    # (the other row_number()s rank the one-row-per-class quota table)
    assert len(re.findall(r"row_number\(\) windowspecdefinition\(label#\d+L?, h#", plan)) == 1
