"""Driver tables with explicit schemas, and the derived views every query
reads: ``documents_emoji`` (all documents, emoji appended by a fixed rule),
``corpus`` (labelled subset), ``predictions`` (five deterministic runs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
}

# --- fixed values -----------------------------------------------------------
# Emoji suffix appended to documents.text, chosen by doc_id % 8 (the fixtures
# carry no emoji).  Index i is the suffix for doc_id % 8 == i.
EMOJI_SUFFIXES = [
    " \U0001f644",                              # face with rolling eyes
    " \U0001f602\U0001f602",                    # two faces with tears of joy
    " \u2764\ufe0f",                            # red heart + VS16
    " \U0001f44d\U0001f3fd",                    # thumbs up, medium skin tone
    " \U0001f1ec\U0001f1e7 1\ufe0f\u20e3",      # flag GB, keycap one
    " \U0001f468\u200d\U0001f469\u200d\U0001f467",  # family ZWJ sequence
    "",
    " \U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f\u2b50",  # flag of England (tags), star
]
# Deterministic prediction runs: p = ((id*A + run_no*B) % 1000) / 1000.
PRED_A = 7919
PRED_B = 104729
N_RUNS = 5
# --- end of fixed values ----------------------------------------------------


# Session setting, unset by default: deal the rows of the tables with heavy
# per-row work (long text, vectors) to this many partitions after the scan.
# The bench sets it, as its files have one row group and would read as one task.
READ_PARTITIONS = "spark.mojiframe.readPartitions"
TEXT_TABLES = {"documents", "conversations", "pages", "embeddings"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(READ_PARTITIONS, None) if name in TEXT_TABLES else None
    return df.repartition(int(parts)) if parts else df


def emoji_suffix(id_col: Column) -> Column:
    m = F.pmod(id_col, F.lit(len(EMOJI_SUFFIXES)))
    expr = F.when(m == 0, F.lit(EMOJI_SUFFIXES[0]))
    for i, s in enumerate(EMOJI_SUFFIXES[1:], start=1):
        expr = expr.when(m == i, F.lit(s))
    return expr


def documents_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ``(id, text, lang, source)`` with the emoji suffix."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("text"), emoji_suffix(F.col("doc_id"))).alias("text"),
        "lang", "source",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus ``(id, text, label, rephrase)``.

    ``label = 1 - quality``; ``rephrase`` is a nullable stand-in (the source
    name where the document is toxic).  Labels cover a subset of documents;
    the equi-join lets AQE pick broadcast or sort-merge from runtime sizes."""
    d = documents_emoji(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels")
    return d.join(lab, d.id == lab.doc_id, "inner").select(
        d.id,
        d.text,
        (F.lit(1) - lab.quality).cast("int").alias("label"),
        F.when(lab.toxic == 1, d.source).alias("rephrase"),
    )


def run_name(run_no: Column) -> Column:
    from mojiframe.sources.runs import run_name_for

    return run_name_for(run_no)


def prediction_p(id_col: Column, run_no: Column) -> Column:
    num = F.pmod(id_col * F.lit(PRED_A) + run_no.cast("long") * F.lit(PRED_B), F.lit(1000))
    return num.cast("double") / F.lit(1000.0).cast("double")


def with_runs(df: DataFrame) -> DataFrame:
    """Fan each row out to the ``N_RUNS`` runs with a generator (no join)."""
    return df.withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(N_RUNS))))


def predictions(spark: SparkSession, sf_dir: str, variants: DataFrame | None = None) -> DataFrame:
    """``(run, id, y_true, y_pred, p, has_emoji, ...)`` for five runs.

    ``variants`` may carry extra columns (text variants) that are kept."""
    from mojiframe.operators.variants import add_variants

    base = variants if variants is not None else add_variants(corpus(spark, sf_dir))
    r = with_runs(base)
    p = prediction_p(F.col("id"), F.col("run_no"))
    return r.select(
        run_name(F.col("run_no")).alias("run"),
        *[c for c in base.columns],
        F.col("label").alias("y_true"),
        p.alias("p"),
        (p >= 0.5).cast("int").alias("y_pred"),
    )
