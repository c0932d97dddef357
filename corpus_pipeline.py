"""The corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input.

Defined results: texts that are null, empty or without letters leave in the first
stage; without labelled rows there is no model and every document leaves; rows are told
apart by id and text, so rows under one id are judged each for itself, and of rows that repeat both
one is left after the set join; ids that are null take no part in the set join, so
their rows stay; extra columns are not carried; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mojiframe.llm.common import materialise, ship
from mojiframe.llm import bpe, langid, linededup, setjoin
from mojiframe.llm.decontaminate import find_contamination

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = tuple(COLUMNS[1:])

MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an unsure one, go."""
    model = langid.train(docs)
    found = langid.identify_language(docs, model, keep=REST)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay at their first place; documents that were nothing else go."""
    found = linededup.dedup_lines(docs, keep=REST[1:])
    left = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 on five-word shingles one row stays: the smallest id, then text hash."""
    rows = docs.select(COLUMNS).withColumn("key", F.xxhash64("text"))
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    found = setjoin.jaccard_components(rows.select(place.alias("place"), "text"), "place", n=5, num=80, den=100)
    copies = found.where(F.col("component_id") != F.col("place")).select("place.*").distinct()
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))  # others are in no group
    once = Window.partitionBy("doc_id", "key").orderBy(*REST[1:])
    left = rows.where(linked).join(copies, ["doc_id", "key"], "left_anti").withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return left.select(COLUMNS).union(rows.where(~linked).select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=REST)
    return found.where(F.col("n_hit") == 0).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and the digests of ids and decoded bytes."""
    return bpe.digests(bpe.encode(docs, keep=("lang", "source"), round_trip=True), "doc_id", keep=("lang", "source"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: No stage chain of models and hashes can be said in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
