"""Structured Streaming: scoring with a saved pipeline (M18, M5-M7 on a stream).

A fitted pipeline is row-local, so the batch scoring code runs on a stream as it
is: no state, no watermark.  The file source's log, the offsets and the sink's
commit log lie in the checkpoint and the output folder; a query that was stopped,
or whose driver was lost, goes on with the batch after its last committed one, and each row is in
the output once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mojiframe.operators.models import positive_probability, threshold


def row_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def score_stream(model: PipelineModel, rows: DataFrame, run: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``(run, *keep, p, y_pred)`` of a stream (or table) of rows."""
    p = positive_probability()
    return model.transform(rows).select(F.lit(run).alias("run"), *keep, p.alias("p"), threshold(p).alias("y_pred"))


def start_scoring(scores: DataFrame, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scores partitioned by run; ``once`` takes what is there and ends, else the query goes on."""
    w = scores.writeStream.format("parquet").partitionBy("run").option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="0 seconds")).start(out_path)
