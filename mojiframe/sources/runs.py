"""Run configurations as a table (S8-S10, K10) and the predictions of many
runs as one table keyed by ``run`` (S6, K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# The five final runs of the study: (run_no, fusion_mode, text_col).
RUNS = [
    (1, "text_only", "x_full"),
    (2, "text_only", "x_text"),
    (3, "gated", "x_text"),
    (4, "concat", "x_text"),
    (5, "emoji_only", "x_text"),
]
SHARED = {"pretrained": "roberta-base", "emoji_col": "x_emoji", "max_len": 128,
          "batch_size": 16, "lr": 2e-5, "epochs": 4, "seed": 43}
FUSION_MODES = ("text_only", "emoji_only", "concat", "gated")
KNOWN_CONFIG_FIELDS = ["run_name", "pretrained", "fusion_mode", "text_col", "emoji_col",
                       "max_len", "batch_size", "lr", "epochs", "seed", "best_dev_macro_f1",
                       "train_label_counts", "model_type", "pretrained_name"]
# --- end of fixed values ----------------------------------------------------

CONFIG_SCHEMA = T.StructType([
    T.StructField("run_no", T.IntegerType()),
    T.StructField("fusion_mode", T.StringType()),
    T.StructField("text_col", T.StringType()),
    T.StructField("pretrained", T.StringType()),
    T.StructField("emoji_col", T.StringType()),
    T.StructField("max_len", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("seed", T.IntegerType()),
])


def make_run_name(mode: Column, text_col: Column, lr: Column, epochs: Column,
                  batch_size: Column, seed: Column) -> Column:
    """``{mode}_{text_col}_roberta_lr{lr}_ep{e}_bs{b}_seed{s}``, lr in
    ``%.0e`` form below 1e-3."""
    lr_str = F.when(lr < 1e-3, F.format_string("%.0e", lr)).otherwise(lr.cast("string"))
    return F.format_string("%s_%s_roberta_lr%s_ep%d_bs%d_seed%d",
                           mode, text_col, lr_str, epochs, batch_size, seed)


def run_name_fields(run: Column) -> Column:
    """The fields that K10 puts in a run name, read back: a struct of fusion_mode, text_col, lr, epochs,
    batch_size and seed, null where the name is of another form."""
    form = r"^(text_only|emoji_only|concat|gated)_(.+)_roberta_lr([0-9.eE+-]+)_ep(\d+)_bs(\d+)_seed(\d+)$"
    part = lambda k: F.regexp_extract(run, form, k)
    fields = F.struct(part(1).alias("fusion_mode"), part(2).alias("text_col"), part(3).try_cast("double").alias("lr"), part(4).try_cast("int").alias("epochs"),
                      part(5).try_cast("int").alias("batch_size"), part(6).try_cast("int").alias("seed"))
    return F.when(run.rlike(form), fields)


def run_config(spark: SparkSession) -> DataFrame:
    """One row per run, with its deterministic name."""
    rows = [(no, mode, col, SHARED["pretrained"], SHARED["emoji_col"], SHARED["max_len"],
             SHARED["batch_size"], SHARED["lr"], SHARED["epochs"], SHARED["seed"])
            for no, mode, col in RUNS]
    df = spark.createDataFrame(rows, CONFIG_SCHEMA)
    return df.withColumn("run", make_run_name(F.col("fusion_mode"), F.col("text_col"), F.col("lr"),
                                              F.col("epochs"), F.col("batch_size"), F.col("seed")))


def run_name_for(run_no: Column) -> Column:
    """The run name of ``run_no`` computed inline (no join)."""
    mode = F.element_at(F.array(*[F.lit(m) for _, m, _ in RUNS]), run_no)
    col = F.element_at(F.array(*[F.lit(c) for _, _, c in RUNS]), run_no)
    return make_run_name(mode, col, F.lit(SHARED["lr"]), F.lit(SHARED["epochs"]),
                         F.lit(SHARED["batch_size"]), F.lit(SHARED["seed"]))


def discover_runs(configs: DataFrame, has_checkpoint: Column | None = None,
                  only_seed: int | None = None) -> DataFrame:
    """Runs whose name does not start with '_', that have a checkpoint,
    optionally of one seed, sorted by name."""
    cond = ~F.col("run").startswith("_")
    if has_checkpoint is not None:
        cond = cond & has_checkpoint
    if only_seed is not None:
        cond = cond & (F.col("seed") == only_seed)
    return configs.where(cond).orderBy("run")


def discover_stored_runs(spark: SparkSession, predictions: str, configs: str, only_seed: int | None = None) -> DataFrame:
    """S8 over what is stored: run folders that have a config document (``run_folder=<name>``
    below ``configs``) and committed rows (in the log of ``predictions``), not named ``_...``,
    optionally of one seed, sorted by name.  Names come from the log's records; no row is read."""
    from mojiframe.sources.runlog import RunLog

    text = spark.read.text(configs, wholetext=True)
    if "run_folder" not in text.columns:
        raise ValueError(f"no run_folder=<name> folders in {configs}")
    parsed = parse_configs(text.select(F.col("value").alias("raw"), F.col("run_folder").cast("string").alias("run_folder")))
    stored = spark.createDataFrame([(r,) for r in sorted(RunLog(spark, predictions).runs())], "stored string")
    have = parsed.join(stored, F.col("run_folder") == F.col("stored"), "left").drop("run", "raw").withColumnRenamed("run_folder", "run")
    return discover_runs(have, F.col("stored").isNotNull(), only_seed).drop("stored")


NUMBERS = {"max_len": "int", "batch_size": "int", "lr": "double", "epochs": "int", "seed": "int", "best_dev_macro_f1": "double"}


def yaml_fields(text: Column) -> Column:
    """A flat YAML document as ``map<string,string>``: ``key: value`` lines, comments,
    quoted scalars and nulls; a value may be a JSON-like flow mapping.  Any other line is an error by its text."""
    bare = lambda x: F.regexp_replace(x, r"(^|\s+)#.*$", "")  # noqa: E731  a comment starts a line or follows a space
    plain = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.when(F.regexp_replace(x, r"^[^:]*:\s*", "").rlike("^[\"']"), x).otherwise(bare(x))),
                     lambda x: ~x.rlike(r"^\s*(---.*)?$"))
    pattern = r"^([A-Za-z_][\w-]*)\s*:(?:\s+(.*?))?\s*$"
    key = lambda x: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(
        F.raise_error(F.concat(F.lit("not a flat YAML line: "), x)).cast("string"))

    def value(x: Column) -> Column:
        v = F.regexp_extract(x, pattern, 2)
        double = F.regexp_extract(v, r'^"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$', 1)
        single = F.replace(F.regexp_extract(v, r"^'((?:[^']|'')*)'\s*(?:#.*)?$", 1), F.lit("''"), F.lit("'"))
        return (F.when(v.rlike(r"^(~|null|Null|NULL)?$"), F.lit(None).cast("string")).when(v.startswith('"'), F.regexp_replace(double, r'\\(["\\])', "$1"))
                .when(v.startswith("'"), single).otherwise(v))

    return F.map_from_entries(F.transform(plain, lambda x: F.struct(key(x).alias("k"), value(x).alias("v"))))


def parse_configs(raw: DataFrame, json_col: str = "raw", strict: bool = True) -> DataFrame:
    """Config documents, JSON or flat YAML, -> typed columns.  Numeric strings such as
    ``"2e-5"`` are cast.  With ``strict`` a field outside the schema, or a number that is none,
    fails the query by the field's name; else it is only listed in ``unknown_fields``, or null."""
    text = F.col(json_col)
    is_json = F.ltrim(text).startswith("{")
    fields = F.when(is_json, F.from_json(text, "map<string,string>", {"mode": "FAILFAST"})).otherwise(yaml_fields(text))
    rows = raw.withColumn("__fields", fields)
    get = lambda k: F.try_element_at(F.col("__fields"), F.lit(k))

    def number(k: str, kind: str) -> Column:
        cast = F.trim(get(k)).try_cast(kind)
        if strict:
            bad = F.raise_error(F.concat(F.lit(f"{k} is no {kind}: "), get(k))).cast(kind)
            cast = F.when(get(k).isNotNull() & cast.isNull(), bad).otherwise(cast)
        return cast.alias(k)

    unknown = F.array_except(F.map_keys("__fields"), F.array(*[F.lit(k) for k in KNOWN_CONFIG_FIELDS]))
    if strict:
        unknown = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown config fields: "), F.array_join(unknown, ", ")))
                         .cast("array<string>")).otherwise(unknown)
    return rows.select(
        *raw.columns, get("run_name").alias("run"), F.coalesce(get("pretrained"), get("pretrained_name")).alias("pretrained"),
        get("model_type").alias("model_type"), get("fusion_mode").alias("fusion_mode"), get("text_col").alias("text_col"),
        get("emoji_col").alias("emoji_col"), *[number(k, kind) for k, kind in NUMBERS.items()],
        F.from_json(get("train_label_counts"), "map<string,bigint>").alias("train_label_counts"), unknown.alias("unknown_fields"))


def read_configs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One document a file, of either form."""
    return parse_configs(spark.read.text(path, wholetext=True).select(F.col("value").alias("raw")), strict=strict)


def with_fallbacks(df: DataFrame, field: str, ckpt_col: str, cfg_col: str, default) -> DataFrame:
    """Checkpoint value, else config-file value, else default."""
    return df.withColumn(field, F.coalesce(F.col(ckpt_col), F.col(cfg_col), F.lit(default)))
