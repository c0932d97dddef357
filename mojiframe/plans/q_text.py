"""Registered text queries (F1-F19, P-projections) over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mojiframe.functions import emoji_lexicon as L
from mojiframe.functions import ngrams as NG
from mojiframe.functions import text as TX
from mojiframe.operators import variants as V
from mojiframe.plans import sqltext as S
from mojiframe.plans.catalog import register
from mojiframe.sources import tables as T

DOCS = f"({S.documents_emoji_sql()})"


def _docs(spark, sf):
    return T.documents_emoji(spark, sf)


# single-code-point test applied to every piece of every text ------------
@register("f01_is_emoji", lambda: (
    f"SELECT id, len(pcs) AS n_pieces, "
    f"len(list_filter(pcs, lambda x: regexp_full_match(x, {S.q(TX.EMOJI)}))) AS n_emoji_pieces "
    f"FROM (SELECT id, regexp_extract_all(text, {S.q(TX.PIECES)}, 1) AS pcs FROM {DOCS})"))
def f01_is_emoji(spark, sf):
    d = _docs(spark, sf).select("id", TX.pieces("text").alias("pcs"))
    return d.select(
        "id",
        F.size("pcs").cast("long").alias("n_pieces"),
        F.size(F.filter("pcs", TX.is_emoji)).cast("long").alias("n_emoji_pieces"),
    )


@register("f02_extract_emoji", lambda: f"SELECT id, {S.extract_emoji('text')} AS emoji FROM {DOCS}")
def f02_extract_emoji(spark, sf):
    return _docs(spark, sf).select("id", TX.extract_emoji("text").alias("emoji"))


@register("f03_extract_emoji_only",
          lambda: f"SELECT id, {S.strip(S.extract_emoji('text'))} AS emoji_only FROM {DOCS}")
def f03_extract_emoji_only(spark, sf):
    return _docs(spark, sf).select("id", TX.extract_emoji_only("text").alias("emoji_only"))


@register("f04_remove_emoji",
          lambda: f"SELECT id, {S.strip(S.remove_seq('text'))} AS x_text FROM {DOCS}")
def f04_remove_emoji(spark, sf):
    return _docs(spark, sf).select("id", TX.py_strip(TX.remove_emoji_sequences("text")).alias("x_text"))


@register("f05_remove_emoji_code_points",
          lambda: f"SELECT id, {S.remove_cp('text')} AS text_only FROM {DOCS}")
def f05_remove_emoji_code_points(spark, sf):
    return _docs(spark, sf).select("id", TX.remove_emoji_code_points("text").alias("text_only"))


@register("f06_demojize", lambda: S.with_ctes(
    S.lexicon_cte(), body=f"SELECT id, {S.strip(S.demojize('text'))} AS x_desc FROM {DOCS} d CROSS JOIN lexm"))
def f06_demojize(spark, sf):
    return V.add_demojized(_docs(spark, sf).select("id", "text"), F.col("text"), "x_desc").select("id", "x_desc")


# F7 on the second schema (conversations.text), padded with Unicode spaces so
# the strip is exercised on every row.
_PAD_L = "\u00a0 \u3000\t"
_PAD_R = " \n\u2003"


@register("f07_strip", lambda: (
    f"SELECT conv_id, turn, {S.strip(S.chars_literal(_PAD_L) + ' || text || ' + S.chars_literal(_PAD_R))} AS text "
    f"FROM conversations"))
def f07_strip(spark, sf):
    c = T.read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn",
                    TX.py_strip(F.concat(F.lit(_PAD_L), "text", F.lit(_PAD_R))).alias("text"))


@register("f08_has_emoji", lambda: f"SELECT id, {S.has_emoji('text')} AS has_emoji FROM {DOCS}")
def f08_has_emoji(spark, sf):
    return _docs(spark, sf).select("id", TX.has_emoji("text").alias("has_emoji"))


@register("f09_any_char_is_emoji", lambda: (
    f"SELECT id, len(regexp_extract_all(coalesce(text, ''), {S.q('(' + TX.EMOJI + ')')}, 1)) > 0 AS has_emoji "
    f"FROM {DOCS}"))
def f09_any_char_is_emoji(spark, sf):
    # notebook form: any character is an emoji (same truth table as F8)
    chars = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("(" + TX.EMOJI_FAST + ")"), 1)
    return _docs(spark, sf).select("id", (F.size(chars) > 0).alias("has_emoji"))


def _variants_sql(src: str = DOCS) -> str:
    return S.with_ctes(S.lexicon_cte(), body=S.variants_sql(src))


@register("f10_has_emoji_from_stream", lambda: S.with_ctes(
    S.lexicon_cte(),
    body=(f"SELECT id, CASE WHEN coalesce({S.strip('x_emoji')}, '') IN ('', {S.q(L.NO_EMOJI)}) "
          f"THEN 0 ELSE 1 END AS has_emoji FROM ({S.variants_sql(DOCS)})")))
def f10_has_emoji_from_stream(spark, sf):
    v = V.add_variants(_docs(spark, sf))
    return v.select("id", TX.has_emoji_from_stream("x_emoji").alias("has_emoji"))


@register("f11_emoji_present", lambda: (
    f"SELECT id, CAST(length({S.strip(S.extract_emoji('text'))}) > 0 AS INTEGER) AS emoji_present FROM {DOCS}"))
def f11_emoji_present(spark, sf):
    return _docs(spark, sf).select("id", TX.emoji_present(TX.extract_emoji("text")).alias("emoji_present"))


@register("f12_sentinel", lambda: (
    f"SELECT id, {S.with_sentinel(S.extract_emoji('text'), S.has_emoji('text'))} AS x_emoji FROM {DOCS}"))
def f12_sentinel(spark, sf):
    d = _docs(spark, sf)
    return d.select("id", TX.with_sentinel(TX.extract_emoji("text"), TX.has_emoji("text")).alias("x_emoji"))


@register("f13_add_variants", lambda: (
    S.with_ctes(S.lexicon_cte(), body=(
        "SELECT id, x_full, x_emoji, has_emoji, x_text, x_desc FROM (" + S.variants_sql(DOCS) + ")"))))
def f13_add_variants(spark, sf):
    return V.add_variants(_docs(spark, sf)).select("id", "x_full", "x_emoji", "has_emoji", "x_text", "x_desc")


@register("f14_notebook_variants", lambda: S.with_ctes(S.lexicon_cte(), body=(
    f"SELECT id, {S.strip(S.extract_emoji(S.as_text('text')))} AS emoji_only, "
    f"{S.remove_cp(S.as_text('text'))} AS text_only, "
    f"{S.strip(S.demojize(S.as_text('text')))} AS emoji_to_text FROM {DOCS} d CROSS JOIN lexm")))
def f14_notebook_variants(spark, sf):
    return V.add_notebook_variants(_docs(spark, sf)).select("id", "emoji_only", "text_only", "emoji_to_text")


# Array results are reported as (count, md5 of the newline-joined
# array) per document, so the check covers every element of whole texts.
def _digest_cols(arr):
    return [F.size(arr).cast("long").alias("n"), F.md5(F.array_join(arr, "\n")).alias("digest")]


def _digest(df, arr):
    """Materialise the array once, then report (id, n, digest)."""
    g = df.select("id", arr.alias("g"))
    return g.select("id", *_digest_cols(F.col("g")))


def _digest_sql(arr: str) -> str:
    return f"CAST(len({arr}) AS BIGINT) AS n, md5(array_to_string({arr}, chr(10))) AS digest"


@register("f15_word_tokens", lambda: f"SELECT id, {_digest_sql(S.word_tokens('text'))} FROM {DOCS}")
def f15_word_tokens(spark, sf):
    return _docs(spark, sf).select("id", *_digest_cols(TX.word_tokens("text")))


def _ngrams_sql(n_max: int = 2) -> str:
    toks = S.word_tokens("text")
    grams = [f"tk"]
    for n in range(2, n_max + 1):
        grams.append(
            f"CASE WHEN len(tk) >= {n} THEN list_transform(range(0, len(tk) - {n - 1}), "
            f"lambda i: array_to_string(tk[i + 1:i + {n}], ' ')) ELSE [] END")
    g = "list_concat(" + ", ".join(grams) + ")" if len(grams) > 1 else grams[0]
    return f"SELECT id, {_digest_sql(g)} FROM (SELECT id, {toks} AS tk FROM {DOCS})"


@register("f16_word_ngrams", _ngrams_sql)
def f16_word_ngrams(spark, sf):
    d = _docs(spark, sf).select("id", TX.word_tokens("text").alias("tk"))
    return _digest(d, TX.word_ngrams(F.col("tk"), 1, 2))


def _char_ngrams_sql(n_min: int = 3, n_max: int = 5) -> str:
    parts = [f"CASE WHEN length(ct) >= {n} THEN list_transform(range(1, length(ct) - {n - 2}), "
             f"lambda i: substr(ct, i, {n})) ELSE [] END" for n in range(n_min, n_max + 1)]
    g = "list_concat(" + ", ".join(parts) + ")"
    return (f"SELECT id, {_digest_sql(g)} FROM (SELECT id, {S.char_text('x_text')} AS ct FROM "
            f"(SELECT id, {S.strip(S.remove_seq('text'))} AS x_text FROM {DOCS}))")


@register("f17_char_ngrams", _char_ngrams_sql)
def f17_char_ngrams(spark, sf):
    # on the emoji-free variant: the reference's char analyser sees x_text
    d = _docs(spark, sf).select("id", TX.py_strip(TX.remove_emoji_sequences("text")).alias("x_text"))
    d = d.select("id", TX.char_text("x_text").alias("ct"))
    return NG.map_char_ngrams(d, "ct", NG.digests, "id long, n long, digest string", 3, 5)


@register("f18_truncate_tokens", lambda: (
    f"SELECT id, {_digest_sql('tk[1:128]')} FROM (SELECT id, {S.word_tokens('text')} AS tk FROM {DOCS})"))
def f18_truncate_tokens(spark, sf):
    return _docs(spark, sf).select("id", *_digest_cols(TX.truncate_tokens(TX.word_tokens("text"), 128)))


@register("f19_variants_long", lambda: S.with_ctes(S.lexicon_cte(), body=(
    "SELECT id, variant, value FROM (" + S.variants_sql(DOCS) + ") v, "
    "LATERAL (VALUES ('full', v.x_full), ('text', v.x_text), ('desc', v.x_desc), ('emoji', v.x_emoji)) "
    "AS t(variant, value)")))
def f19_variants_long(spark, sf):
    return V.variants_long(V.add_variants(_docs(spark, sf)))


# P-projections ---------------------------------------------------------------
@register("p02_as_text", lambda: (
    "SELECT conv_id, turn, coalesce(CAST(text AS VARCHAR), 'nan') AS text, "
    "coalesce(CAST(CASE WHEN role <> 'system' THEN turn END AS VARCHAR), 'nan') AS spoken_turn FROM conversations"))
def p02_as_text(spark, sf):
    """Every text, and a number that is null for system turns."""
    c = T.read_table(spark, sf, "conversations")
    spoken = F.when(F.col("role") != "system", F.col("turn"))
    return c.select("conv_id", "turn", TX.as_text("text").alias("text"), TX.as_text(spoken).alias("spoken_turn"))


@register("p06_variant_columns", lambda: S.with_ctes(S.lexicon_cte(), body=(
    "SELECT id, variant, value FROM (" + S.variants_sql(f"(SELECT * FROM {DOCS})") + ") v, "
    "LATERAL (VALUES ('text', v.x_text), ('demojized', v.x_desc), ('full', v.x_full)) AS t(variant, value)")))
def p06_variant_columns(spark, sf):
    v = V.add_variants(_docs(spark, sf))
    cols = ", ".join(f"'{k}', {V.variant_to_column(k)}" for k in ("text", "demojized", "full"))
    return v.select("id", F.expr(f"stack(3, {cols})").alias("variant", "value"))


@register("p11_head_preview", lambda: S.with_ctes(S.lexicon_cte(), body=(
    "SELECT id, x_text, x_emoji, has_emoji FROM (" + S.variants_sql(DOCS) + ") ORDER BY id LIMIT 3")))
def p11_head_preview(spark, sf):
    v = V.add_variants(_docs(spark, sf))
    return v.select("id", "x_text", "x_emoji", "has_emoji").orderBy("id").limit(3)
