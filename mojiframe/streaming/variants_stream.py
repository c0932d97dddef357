"""Structured Streaming: the text variants are stateless column expressions,
so the same ``add_variants`` runs on a streaming DataFrame.  No state, no
watermark is needed (nothing is aggregated across rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mojiframe.operators.variants import add_variants
from mojiframe.sources import tables as T


def document_stream(spark: SparkSession, source_dir: str, table: str = "documents",
                    max_files_per_trigger: int = 100) -> DataFrame:
    """A file stream over the parquet files of one table in ``source_dir``: files of its name,
    or the files, whatever their names, in a folder of its name."""
    return (spark.readStream.schema(T.SCHEMAS[table])
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(f"{source_dir.rstrip('/')}/{table}*.parquet"))


def variants_stream(docs: DataFrame, spread_to: int | None = None) -> DataFrame:
    """Streaming documents -> ``(id, x_full, x_emoji, has_emoji, x_text, x_desc)``.

    ``spread_to`` round-robins each micro-batch when it holds too few files
    to use the cluster (a large trigger has enough splits already)."""
    from pyspark.sql import functions as F

    if spread_to:
        docs = docs.repartition(spread_to)
    d = docs.select(F.col("doc_id").alias("id"),
                    F.concat(F.col("text"), T.emoji_suffix(F.col("doc_id"))).alias("text"))
    return add_variants(d).select("id", "x_full", "x_emoji", "has_emoji", "x_text", "x_desc")


def start_to_parquet(df: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to parquet with a checkpoint (exactly-once file sink); with
    ``available_now`` the query processes what is there and stops."""
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_path)
