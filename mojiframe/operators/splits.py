"""Exact, reproducible stratified train/dev split (SP1-SP3, J1, J5).

Sizes follow the stratified shuffle-split rule: ``n_dev = ceil(dev_size*n)``;
per-class *train* quotas are the floors of ``n_c / n * n_train`` plus one for
the classes with the largest remainders (ties: smaller label first); the dev
quota of a class is what is left.  Which rows go to dev is fixed by a hash
order ``md5(seed || '-' || id)`` (then id), so the result does not depend on
partitioning, file order or executor count.

Scale: a window ``partition by label`` would put a whole class (possibly a
third of all rows or more) in one task.  Instead rows are bucketed by the
first 20 bits of the hash; bucket counts per label (at most 2^20 per label,
independent of data size) give, per label, the one boundary bucket where the
quota is reached.  Only the rows of that single boundary bucket (~n_c / 2^20)
are ranked, which gives the last dev row of each label in hash order; a row is dev
if it does not come after it.  All of this reads ids and labels; the other columns
pass once, through the final projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 5  # 20 bits -> at most 1,048,576 buckets per label


def hash_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), id_col.cast("string")))


def split_quotas(label_counts: DataFrame, dev_size: float, label: str = "label") -> DataFrame:
    """``(label, n_c)`` -> ``(label, n_c, train_quota, dev_quota)``.

    One row per class; the windows below run over that tiny table."""
    all_ = Window.partitionBy()
    n = F.sum("n_c").over(all_)
    n_dev = F.ceil(F.lit(float(dev_size)) * n)
    q = label_counts.select(
        label, "n_c",
        (n.cast("double") - n_dev.cast("double")).alias("n_train"),
        n.alias("n"),
    ).withColumn("cont", F.col("n_c").cast("double") / F.col("n").cast("double") * F.col("n_train"))
    q = q.withColumn("base", F.floor("cont")).withColumn("rem", F.col("cont") - F.col("base"))
    leftover = (F.col("n_train") - F.sum("base").over(all_)).cast("long")
    rank = F.row_number().over(Window.orderBy(F.col("rem").desc(), F.col(label)))
    q = q.withColumn("train_quota", (F.col("base") + F.when(rank <= leftover, 1).otherwise(0)).cast("long"))
    return q.select(label, F.col("n_c").cast("long").alias("n_c"), "train_quota",
                    (F.col("n_c") - F.col("train_quota")).cast("long").alias("dev_quota"))


def stratified_split(df: DataFrame, dev_size: float = 0.15, seed: int = 42,
                     id_col: str = "id", label: str = "label", keep: list[str] = ()) -> DataFrame:
    """``(id, label, split, *keep)`` with split in ('train', 'dev'), exact
    quotas; ``keep`` columns ride along (no join back to the input)."""
    keyed = df.withColumn("__h", hash_key(F.col(id_col), seed))
    narrow = df.select(F.col(id_col).alias("id"), F.col(label).alias("label")).withColumn("h", hash_key(F.col("id"), seed))
    narrow = narrow.withColumn("bucket", F.conv(F.substring("h", 1, BUCKET_HEX_DIGITS), 16, 10).cast("int"))
    last = _last_dev_rows(narrow, dev_size)
    # one row per class: a size bound that does not grow with the data
    out = keyed.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("__label")), "left")
    dev = F.struct(F.col("__h"), F.col(id_col).alias("id")) <= F.col("__last")
    return out.select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                      F.when(F.coalesce(dev, F.lit(False)), "dev").otherwise("train").alias("split"), *keep)


def _last_dev_rows(narrow: DataFrame, dev_size: float) -> DataFrame:
    """``(__label, __last)``: per label (null is one) the last ``(h, id)`` of dev in hash
    order.  Reads ids and labels only: bucket counts find the boundary bucket, its
    rows alone are ranked."""
    bucket_counts = narrow.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    quotas = split_quotas(bucket_counts.groupBy("label").agg(F.sum("cnt").alias("n_c")), dev_size)
    quotas = quotas.select(F.col("label").alias("q_label"), "dev_quota")
    w = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = (bucket_counts.join(F.broadcast(quotas), F.col("label").eqNullSafe(F.col("q_label")))
           .withColumn("cum_incl", F.sum("cnt").over(w)))
    boundary = (cum.where((F.col("dev_quota") > 0) & (F.col("cum_incl") >= F.col("dev_quota")))
                .groupBy("q_label", "dev_quota")
                .agg(F.min_by(F.struct("bucket", (F.col("cum_incl") - F.col("cnt")).alias("before")),
                              F.col("bucket")).alias("b"))
                .select("q_label", F.col("b.bucket").alias("b_star"), (F.col("dev_quota") - F.col("b.before")).alias("need")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    edge = (narrow.join(F.broadcast(boundary), F.col("label").eqNullSafe(F.col("q_label")) & (F.col("bucket") == F.col("b_star")))
            .withColumn("r", rank).where(F.col("r") == F.col("need")))
    return edge.select(F.col("label").alias("__label"), F.struct(F.col("h").alias("__h"), "id").alias("__last"))


def stratified_split_window(df: DataFrame, dev_size: float = 0.15, seed: int = 42,
                            id_col: str = "id", label: str = "label") -> DataFrame:
    """Reference form of the same split (one window per class); used by tests
    on small inputs to check ``stratified_split``."""
    base = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                     hash_key(F.col(id_col), seed).alias("h"))
    quotas = split_quotas(base.groupBy("label").agg(F.count(F.lit(1)).alias("n_c")), dev_size)
    r = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    return (base.join(quotas, "label").withColumn("r", r)
            .select("id", "label", F.when(F.col("r") <= F.col("dev_quota"), "dev")
                    .otherwise("train").alias("split")))


def sample_split(df: DataFrame, dev_size: float = 0.15, seed: int = 42, label: str = "label") -> DataFrame:
    """SP2: approximate stratified split (cheap, inexact): dev are the rows whose
    hash lies in the first ``dev_size`` of its range, in every label alike.  The
    result does not depend on how the rows lie in partitions."""
    cut = f"{int(dev_size * 2 ** 32):08x}"
    dev = F.substring(hash_key(F.col("id"), seed), 1, 8) < cut
    return df.select("id", label, F.when(dev, "dev").otherwise("train").alias("split"))


def select_split(df: DataFrame, splits: DataFrame, which: str, key: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is in split ``which`` (left semi join)."""
    return df.join(splits.where(F.col("split") == which).select(key), key, "left_semi")


def split_sanity(splits: DataFrame, universe: DataFrame, key: str = "id") -> DataFrame:
    """SP3/J5: one row of checks - sizes, train/dev overlap, duplicates and
    universe ids that are in no split.  One grouping by id, one join on id."""
    per_id = splits.groupBy(key).agg(
        F.count_if(F.col("split") == "train").alias("t"),
        F.count_if(F.col("split") == "dev").alias("d"),
    )
    u = universe.select(key).distinct().withColumn("in_universe", F.lit(True))
    j = per_id.join(u, key, "full")
    return j.agg(
        F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("n_train"),
        F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n_dev"),
        F.count_if((F.col("t") > 0) & (F.col("d") > 0)).alias("overlap"),
        F.count_if(F.col("t") + F.col("d") > 1).alias("duplicated"),
        F.count_if(F.col("t").isNull()).alias("missing"),
        F.count_if(F.col("in_universe").isNull()).alias("unknown"),
    )
