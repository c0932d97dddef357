"""Spark session helpers.

The library never creates a session on a cluster: callers pass their own.
``get_session`` is for tests, the bench and local use.  ``checkpoint_dir``
reads the shared folder the cluster names in ``spark.checkpoint.dir`` and
only falls back to a scratch folder when the setting is absent (tests).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # shuffle partitions are sized to the local cores already; keep AQE from
    # merging small-by-bytes but compute-heavy partitions (text, vectors)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "mojiframe", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  A scratch one is set only where none is
    named and the session is local; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:  # a local session: tests, bench
        d = tempfile.mkdtemp(prefix="mojiframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, whatever reads it
    and whichever executors are lost.  ``discard`` removes it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by ``stored``."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers where their path does not have it."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any("mojiframe-" in x for x in sc._python_includes):
        return
    stem = f"{tempfile.mkdtemp()}/mojiframe-{uuid.uuid4().hex}"
    sc.addPyFile(shutil.make_archive(stem, "zip", root, "mojiframe"))
