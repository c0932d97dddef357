"""Text variants of a corpus (F13, F14, F19) and column choices.

``add_variants`` is one projection: no shuffle, no Python, one codegen stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiframe.functions import text as TX

VARIANT_COLUMNS = {"text": "x_text", "demojized": "x_desc", "full": "x_full"}


def text_column(df: DataFrame, candidates: tuple[str, ...] = ("tweet", "text")) -> str:
    """The first candidate present in the schema, else ``ValueError``."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"the rows have none of the text columns {', '.join(candidates)}")


def variant_to_column(variant: str) -> str:
    """Model variant -> variant column."""
    try:
        return VARIANT_COLUMNS[variant]
    except KeyError:
        raise ValueError(f"{variant!r} is no variant; there are {', '.join(VARIANT_COLUMNS)}") from None


def add_variants(df: DataFrame, null_text: str = "nan") -> DataFrame:
    """``x_full, x_emoji, has_emoji, x_text, x_desc`` appended to ``df``.

    ``x_full``/``x_emoji`` are not stripped, ``x_text``/``x_desc`` are; texts
    without emoji get the ``<NO_EMOJI>`` sentinel in ``x_emoji``.

    Two passes over each text find its sequences and, if there are any, the text
    between them; every variant is made of these.  (Each emoji code point is part of
    a sequence, so the stream and the flag read the sequences only.)"""
    keep = list(df.columns)
    t = df.select("*", TX.as_text(F.col(text_column(df)), null_text).alias("x_full"))
    t = t.select("*", TX.emoji_sequences("x_full").alias("__found"))
    t = t.select("*", F.when(F.size("__found") > 0, TX.text_segments("x_full")).alias("__between"))
    some, found = F.size("__found") > 0, F.array_join("__found", "")
    flag = TX.has_emoji(found)
    return t.select(
        *keep, "x_full",
        TX.with_sentinel(TX.extract_emoji(found), flag).alias("x_emoji"),
        flag.alias("has_emoji"),
        TX.py_strip(F.when(some, F.array_join("__between", "")).otherwise(F.col("x_full"))).alias("x_text"),
        TX.py_strip(F.when(some, TX.interleave_names(F.col("__between"), F.col("__found"))).otherwise(F.col("x_full"))).alias("x_desc"),
    )


def add_demojized(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``out`` is the text with every emoji sequence named, stripped.  The sequences and the text between
    them are columns of their own, so each is found once (see ``add_variants``)."""
    keep = list(df.columns)
    t = df.select("*", text.alias("__t")).select("*", TX.emoji_sequences("__t").alias("__found"))
    t = t.select("*", F.when(F.size("__found") > 0, TX.text_segments("__t")).alias("__between"))
    named = F.when(F.size("__found") > 0, TX.interleave_names(F.col("__between"), F.col("__found"))).otherwise(F.col("__t"))
    return t.select(*keep, TX.py_strip(named).alias(out))


def add_notebook_variants(df: DataFrame, null_text: str = "nan") -> DataFrame:
    """``emoji_only, text_only, emoji_to_text``, all stripped, no sentinel."""
    text = TX.as_text(F.col(text_column(df)), null_text)
    t = df.select("*", TX.extract_emoji_only(text).alias("emoji_only"), TX.remove_emoji_code_points(text).alias("text_only"))
    return add_demojized(t, text, "emoji_to_text")


def variants_long(df: DataFrame, key: str = "id") -> DataFrame:
    """one row per (key, variant) - full, text, desc, emoji."""
    return df.select(
        key,
        F.expr("stack(4, 'full', x_full, 'text', x_text, 'desc', x_desc, 'emoji', x_emoji)")
        .alias("variant", "value"),
    )


def pick_column(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns that exist, in the given order."""
    return [c for c in wanted if c in df.columns]


def readable_text_column(df: DataFrame) -> str:
    """Text, tweet, x_full, else x_text."""
    for c in ("text", "tweet", "x_full"):
        if c in df.columns:
            return c
    return "x_text"


def optional_column(df: DataFrame, name: str, default=0) -> Column:
    """The column if present, else a literal default."""
    return F.col(name) if name in df.columns else F.lit(default).alias(name)
