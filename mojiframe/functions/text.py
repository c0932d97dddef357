"""Text expressions that keep, drop, name or isolate emoji (F1-F19), built only from Spark SQL functions.

Every function takes and returns a ``Column``; nothing here runs Python per
row, so the expressions stay inside whole-stage codegen and run unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mojiframe.functions import emoji_lexicon as L


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _re(pattern: str) -> Column:
    return F.lit(pattern)


# --- patterns (compiled once per task; each is a literal) -------------------
EMOJI = L.emoji_class()
NON_EMOJI_RUN = L.non_emoji_run()
SEQ = L.seq_pattern()
SEQ_FULL = f"^(?:{SEQ})$"
PIECES = L.piece_pattern()
FLAG_FULL = "^[\\x{1F1E6}-\\x{1F1FF}]{2}$"
KEYCAP_FULL = "^[0-9#*]\\x{FE0F}?\\x{20E3}$"
SEQ_PART = "([^\\x{200D}\\x{FE0F}\\x{E0020}-\\x{E007F}])"
WORD_TOKEN = "[\\p{L}\\p{N}_]{2,}"

# Spark-side forms of the same patterns.  Java tests a character against a
# class range by range, so the ~150 ranges are nested as a tree; text below
# U+00A9 leaves it at the first comparison.  The matches are identical (the
# SQL oracle uses the plain forms above).
EMOJI_FAST = L.class_tree(L.emoji_ranges())
# every sequence starts with a keycap base, an emoji or a regional indicator
_STARTERS = "0-9#*" + L.class_tree(L.high_starter_ranges())
SEQ_FAST = f"(?=[{_STARTERS}])(?:" + L.seq_pattern_with(EMOJI_FAST) + ")"
# runs that cannot start a sequence are most of a text: tried first, as no sequence begins in one
PIECES_FAST = f"(?s)([^{_STARTERS}]+|{SEQ_FAST}|.)"
# runs of two or more whitespace characters (the char analyzer's collapse rule)
WS_RUN = "[" + "".join("\\x{%X}" % ord(c) for c in L.STRIP_CHARS) + "]{2,}"


@lru_cache(maxsize=1)
def lexicon_map() -> Column:
    """The emoji lexicon as a literal ``map<string,string>``."""
    rows = L.lexicon_rows()
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k, _, _ in rows]),
        F.array(*[F.lit(v) for _, v, _ in rows]),
    )


@lru_cache(maxsize=1)
def territory_map() -> Column:
    """Country code -> English name with underscores, from the JVM's locale data."""
    from pyspark import SparkContext

    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    names = {}
    for code in [*locale.getISOCountries(), *L.OTHER_TERRITORIES]:
        name = locale("", code).getDisplayCountry(locale.ENGLISH)
        if name != code:
            names[code] = name.replace(" ", "_")
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))


# F7 -------------------------------------------------------------------------
def py_strip(col: Column | str) -> Column:
    """Strip Unicode whitespace at both ends, as Python's ``str.strip()``."""
    return F.btrim(_c(col), F.lit(L.STRIP_CHARS))


# P2 -------------------------------------------------------------------------
def as_text(col: Column | str, null_text: str = "nan") -> Column:
    """Cast to string; NULL becomes ``null_text`` (pandas ``astype(str)``)."""
    return F.coalesce(_c(col).cast("string"), F.lit(null_text))


# F1 -------------------------------------------------------------------------
def is_emoji(col: Column | str) -> Column:
    """True when the value is exactly one emoji code point (which has at most four bytes,
    and ``$`` allows a line end of three after it: longer values are not read)."""
    return (F.octet_length(_c(col)) <= 7) & _c(col).rlike(f"^{EMOJI_FAST}$")


def pieces(col: Column | str) -> Column:
    """A text cut into its emoji sequences, runs of characters that cannot start one, and single other characters."""
    return F.regexp_extract_all(_c(col), _re(PIECES_FAST), 1)


# F2 / F3 ----------------------------------------------------------------------
def extract_emoji(col: Column | str) -> Column:
    """Emoji code points in order, duplicates kept, no separator; NULL -> ''."""
    found = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), _re(f"({EMOJI_FAST})"), 1)
    return F.array_join(found, "")


def extract_emoji_only(col: Column | str) -> Column:
    return py_strip(extract_emoji(col))


# F4 / F5 ----------------------------------------------------------------------
def remove_emoji_sequences(col: Column | str) -> Column:
    """Remove whole emoji sequences (ZWJ chains, flags, keycaps, VS16, tones)."""
    return F.regexp_replace(_c(col), _re(SEQ_FAST), F.lit(""))


def remove_emoji_code_points(col: Column | str) -> Column:
    """Remove single emoji code points, then strip (notebook variant)."""
    return py_strip(F.regexp_replace(_c(col), _re(EMOJI_FAST), F.lit("")))


# F6 -------------------------------------------------------------------------
def emoji_name(piece: Column) -> Column:
    """Short name of one emoji sequence: lexicon entry, else the territory of a flag, keycap
    rule, else the names of its code points joined by '_'."""
    parts = F.regexp_extract_all(piece, _re(SEQ_PART), 1)
    by_parts = F.array_join(
        F.transform(parts, lambda c: F.coalesce(F.try_element_at(lexicon_map(), c), c)), "_"
    )
    code = F.translate(piece, L.regional_indicators(), L.latin_capitals())
    return F.coalesce(
        F.try_element_at(lexicon_map(), piece),
        F.when(piece.rlike(FLAG_FULL), F.coalesce(F.try_element_at(territory_map(), code), F.concat(F.lit("flag_"), code)))
        .when(piece.rlike(KEYCAP_FULL), F.concat(F.lit("keycap_"), F.substring(piece, 1, 1)))
        .otherwise(by_parts),
    )


def has_emoji_sequence(col: Column | str) -> Column:
    return _c(col).rlike(SEQ_FAST)


def emoji_sequences(col: Column | str) -> Column:
    """The emoji sequences of a text, in order (one pass over the text)."""
    return F.regexp_extract_all(_c(col), _re(f"({SEQ_FAST})"), 1)


def text_segments(col: Column | str) -> Column:
    """The text before each sequence and after the last (one pass; a trailing empty
    match may follow the n + 1 segments)."""
    return F.regexp_extract_all(_c(col), _re(f"(?s)(.*?)(?:{SEQ_FAST}|\\z)"), 1)


def interleave_names(segments: Column, sequences: Column, delimiters: tuple[str, str] = (" ", " ")) -> Column:
    """Segments and the names of the sequences between them."""
    named = F.zip_with(F.slice(segments, 1, F.size(sequences)), sequences, lambda p, x: F.concat(
        p, F.lit(delimiters[0]), emoji_name(x), F.lit(delimiters[1])))
    return F.concat(F.array_join(named, ""), F.element_at(segments, F.size(sequences) + 1))


def demojize(col: Column | str, delimiters: tuple[str, str] = (" ", " ")) -> Column:
    """Replace every emoji sequence by ``<d0>name<d1>``; other text unchanged.

    The text between sequences (n + 1 segments) and the sequences (n) are
    extracted, then interleaved; only the emoji are looked up.  Texts
    without a sequence are returned as they are.  (``split`` would compile
    the pattern once per row; ``regexp_extract_all`` compiles it once.)"""
    t = _c(col)
    return F.when(has_emoji_sequence(t), interleave_names(text_segments(t), emoji_sequences(t), delimiters)).otherwise(t)


# F8-F12 ---------------------------------------------------------------------
def has_emoji(col: Column | str) -> Column:
    """True when any single code point is an emoji (flags/keycaps alone: False)."""
    return F.coalesce(_c(col).rlike(EMOJI_FAST), F.lit(False))


def has_emoji_from_stream(col: Column | str) -> Column:
    """0/1 from an emoji stream column: stripped value not in ('', sentinel)."""
    s = py_strip(_c(col).cast("string"))
    return F.when(F.coalesce(s, F.lit("")).isin("", L.NO_EMOJI), F.lit(0)).otherwise(F.lit(1))


def emoji_present(col: Column | str) -> Column:
    return (F.length(py_strip(F.coalesce(_c(col), F.lit("")))) > 0).cast("int")


def with_sentinel(stream: Column, flag: Column) -> Column:
    return F.when(~flag, F.lit(L.NO_EMOJI)).otherwise(stream)


# F15-F18 --------------------------------------------------------------------
def word_tokens(col: Column | str) -> Column:
    """Lower-cased word tokens of length >= 2 (letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(_c(col)), _re(WORD_TOKEN), 0)


def _ngram_at(tokens: Column, n: int):
    # one-argument lambda: PySpark passes (element, index) to two-argument ones
    return lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])


def word_ngrams(tokens: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """All word n-grams n_min..n_max, each joined by one space, in order
    (n-grams of one n before the next).

    ``tokens`` should be a column reference (materialise it with a select
    first): the lambdas read it per n-gram."""
    per_n = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            per_n.append(tokens)
            continue
        m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        if n == 2:
            grams = F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m),
                               lambda a, b: F.concat_ws(" ", a, b))
        else:
            grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), _ngram_at(tokens, n))
        per_n.append(F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>")))
    return per_n[0] if len(per_n) == 1 else F.concat(*per_n)


def char_text(col: Column | str) -> Column:
    """Lower-case and collapse runs of >= 2 whitespace to one space."""
    return F.regexp_replace(F.lower(_c(col)), _re(WS_RUN), F.lit(" "))


def char_ngrams(prepared: Column | str, n_min: int = 3, n_max: int = 5) -> Column:
    """Character n-grams n_min..n_max of a prepared text (see ``char_text``),
    in order.  One regex pass per n: a zero-width lookahead captures every
    window, which is linear in the text (substring by index is not)."""
    t = _c(prepared)
    return F.concat(*[F.regexp_extract_all(t, _re("(?s)(?=(.{%d}))" % n), 1)
                      for n in range(n_min, n_max + 1)])


def truncate_tokens(tokens: Column, max_len: int = 128) -> Column:
    return F.slice(tokens, 1, max_len)
