"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mojiframe.llm.common import narrow


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, where: Column | None,
                    rows: int, size: int) -> DataFrame:
    """(h, t, text, label): per label the ``rows`` rows of smallest id hash, as far as
    ``size`` text bytes go; rows without text or label take no part."""
    d = narrow(docs if where is None else docs.where(where), id=id_col, text=text_col, label=label_col)
    d = d.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select(
        "text", "label", F.xxhash64(F.lit(11), F.col("id").cast("string")).alias("h"), F.xxhash64("text").alias("t"),
        F.octet_length("text").alias("size")).where(F.col("size") <= size)
    keys = first_rows(d.select("label", "h", "t", "size"), rows, size, ("h", "t"))
    last = keys.groupBy("label").agg(F.max(F.struct("h", "t")).alias("last"))  # one row a label
    found = d.join(F.broadcast(last), "label").where(F.struct("h", "t") <= F.col("last"))
    return found.select("h", "t", "text", "label").dropDuplicates(["h", "t", "label"])


def first_rows(d: DataFrame, rows: int, size: int | None, order: tuple[str, ...]) -> DataFrame:
    """Per ``label`` the first ``rows`` rows by ``order``, as far as ``size`` of the column ``size`` goes.  ``order`` starts with
    a 64-bit hash.  Counts by its first 12 bits say in which range of hashes a label's
    list ends, so only the rows up to there are ranked: about ``rows`` and one 4,096th of the label."""
    d = d.withColumn("__range", F.shiftright(F.col(order[0]), 52))
    upto = Window.partitionBy("label").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("label", "__range").agg(F.count("*").alias("n"), F.sum("size" if size else F.lit(0)).alias("bytes"))
    before = counts.select("label", "__range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes"))
    open_ = before.where((F.col("n") < rows) & (F.col("bytes") <= (size or 0))).groupBy("label").agg(F.max("__range").alias("__last"))  # one row a label
    near = d.join(F.broadcast(open_), "label").where(F.col("__range") <= F.col("__last")).drop("__range", "__last")
    by = Window.partitionBy("label").orderBy(*order)
    near = near.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= rows)
    if size:
        near = near.withColumn("__s", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__s") <= size).drop("__s")
    return near.drop("__r")
