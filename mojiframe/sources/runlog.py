"""Tables of runs with a commit log (K6, K7).

Rows are written under ``data/attempt=<id>/run=<run>``, where nobody reads them, and count
only once a record that names the attempt and its runs is in the log.  Records are
numbered; one is written whole under a name of its own and then renamed to the next number.  The rename never replaces a file,
so of two writers one gets the number and the other looks at the log
again: a run that has come in meanwhile is refused, or left as it is, for both.
A job that fails leaves an attempt without a record, which is as if it had never been."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "%012d.json"


class RunLog:
    """The log of one table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.folder = self.hadoop.Path(f"{self.path}/_commits")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def records(self) -> list[dict]:
        """All commits in order: ``{"attempt": ..., "runs": [...]}``."""
        if not self.fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        return [self._read(n) for n in sorted(n for n in names if not n.startswith("."))]

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self.hadoop.Path(self.folder, name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def runs(self) -> dict[str, str]:
        """The attempt of every committed run."""
        return {run: r["attempt"] for r in self.records() for run in r["runs"]}

    def _claim(self, number: int, record: dict) -> bool:
        """Write the record under this number; False where the number is taken."""
        own = self.hadoop.Path(self.folder, f".{record['attempt']}.json")
        stream = self.fs.create(own, True)
        stream.write(bytearray(json.dumps(record).encode("utf-8")))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        never = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.hadoop.FileContext.getFileContext(self.folder.toUri(), self.spark._jsc.hadoopConfiguration())
        target = self.fs.makeQualified(self.hadoop.Path(self.folder, RECORD % number))
        try:
            context.rename(self.fs.makeQualified(own), target, never)
            return True
        except Exception:
            if not self.fs.exists(target):
                raise
            return False

    def commit(self, attempt: str, runs: list[str], existing: str) -> list[str]:
        """Make the attempt's runs count, all in one record; the runs that did."""
        while True:
            records = self.records()
            taken = {run for r in records for run in r["runs"]}
            if existing == "error" and taken & set(runs):
                raise FileExistsError(f"{self.path} already holds {', '.join(sorted(taken & set(runs))[:3])}")
            new = sorted(set(runs) - taken)
            if not new or self._claim(len(records), {"attempt": attempt, "runs": new}):
                return new

    def discard(self, attempt: str) -> None:
        """Remove the rows of an attempt that was not committed."""
        if any(r["attempt"] == attempt for r in self.records()):
            raise ValueError(f"attempt {attempt} is committed")
        self.fs.delete(self.hadoop.Path(f"{self.path}/data/attempt={attempt}"), True)


def stage(df: DataFrame, path: str) -> tuple[str, list[str]]:
    """Write rows where they do not count yet; the attempt and its runs."""
    attempt = uuid.uuid4().hex
    where = f"{path.rstrip('/')}/data/attempt={attempt}"
    df.write.partitionBy("run").parquet(where)
    spark = df.sparkSession
    runs = spark.read.option("basePath", where).schema(df.schema).parquet(where).select("run").distinct() if df.columns else None
    return attempt, [r.run for r in runs.collect()]  # names only


def append_runs(df: DataFrame, path: str, existing: str = "error") -> list[str]:
    """Append the rows of runs.  Runs that are there already are never overwritten:
    ``existing="error"`` refuses the whole write (K6), ``existing="keep"`` writes only
    the runs that are new (K7).  Returns the runs that were added."""
    if existing not in ("error", "keep"):
        raise ValueError(f"existing is 'error' or 'keep', not {existing!r}")
    log = RunLog(df.sparkSession, path)
    there = sorted(log.runs())
    if there and existing == "keep":
        df = df.where(~F.col("run").isin(there))
    elif there:
        both = df.where(F.col("run").isin(there)).select("run").distinct().limit(3).collect()
        if both:
            raise FileExistsError(f"{path} already holds {', '.join(sorted(r.run for r in both))}")
    attempt, runs = stage(df, path)
    try:
        return log.commit(attempt, runs, existing)
    except FileExistsError:
        log.discard(attempt)
        raise


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The committed rows, of some runs or of all; runs prune partitions."""
    log = RunLog(spark, path)
    records = [r for r in log.records() if runs is None or set(runs) & set(r["runs"])]
    if not records:
        held = log.records()
        if not held:
            raise FileNotFoundError(f"no runs in {path}")
        records, runs = held[:1], []
    base = f"{path.rstrip('/')}/data"
    df = spark.read.option("basePath", base).parquet(*[f"{base}/attempt={r['attempt']}" for r in records])
    for r in records:  # an attempt may hold runs that another writer was first to commit
        own = log.fs.listStatus(log.hadoop.Path(f"{base}/attempt={r['attempt']}"))
        if sum(s.isDirectory() for s in own) > len(r["runs"]):
            df = df.where((F.col("attempt") != r["attempt"]) | F.col("run").isin(r["runs"]))
    return (df if runs is None else df.where(F.col("run").isin(runs))).drop("attempt")
