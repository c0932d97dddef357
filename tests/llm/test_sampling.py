"""Samples picked by ranges of hashes are those of a ranking over all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mojiframe.llm.sampling import first_rows


@pytest.mark.parametrize("rows, size", [(5, 10**9), (300, 4_000), (300, None), (50, 60), (10**6, 10**9)])
def test_same_rows_as_a_full_ranking(spark, rows, size):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 7)).alias("label"),
                                 F.xxhash64("id").alias("h"), F.col("id").alias("t"), (F.col("id") % 40).alias("size"))
    by = Window.partitionBy("label").orderBy("h", "t")
    want = d.withColumn("r", F.row_number().over(by)).where(F.col("r") <= rows)
    if size:
        want = want.withColumn("s", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("s") <= size)
    got = first_rows(d, rows, size, ("h", "t"))
    assert sorted(r.t for r in got.collect()) == sorted(r.t for r in want.collect())
