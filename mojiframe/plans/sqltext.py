"""The text expressions of ``functions.text`` as ANSI/DuckDB SQL snippets.

Used by the oracle SQL of registered queries: the patterns are the same
strings the Spark side compiles, generated from the same lexicon."""

from __future__ import annotations

from functools import lru_cache

from mojiframe.functions import emoji_lexicon as L
from mojiframe.functions import text as TX


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def chars_literal(s: str) -> str:
    """A string of arbitrary characters, spelled with chr() so that control
    characters never appear raw in SQL text."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {chars_literal(L.STRIP_CHARS)})"


def as_text(x: str, null_text: str = "nan") -> str:
    return f"coalesce(CAST({x} AS VARCHAR), {q(null_text)})"


def extract_emoji(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q(TX.NON_EMOJI_RUN)}, '', 'g')"


def has_emoji(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(TX.EMOJI)}), false)"


def remove_seq(x: str) -> str:
    return f"regexp_replace({x}, {q(TX.SEQ)}, '', 'g')"


def remove_cp(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(TX.EMOJI)}, '', 'g')")


@lru_cache(maxsize=1)
def lexicon_map_sql() -> str:
    rows = L.lexicon_rows()
    keys = ", ".join(q(k) for k, _, _ in rows)
    vals = ", ".join(q(v) for _, v, _ in rows)
    return f"MAP([{keys}], [{vals}])"


def lexicon_cte() -> str:
    """CTE ``lexm(m)`` holding the lexicon map once."""
    return f"lexm AS (SELECT {lexicon_map_sql()} AS m)"


def _lookup(m: str, k: str) -> str:
    return f"map_extract({m}, {k})[1]"


def emoji_name(p: str, m: str = "lexm.m") -> str:
    ri = q(L.regional_indicators())
    az = q(L.latin_capitals())
    parts = (f"array_to_string(list_transform(regexp_extract_all({p}, {q(TX.SEQ_PART)}, 1), "
             f"lambda c: coalesce({_lookup(m, 'c')}, c)), '_')")
    return (f"coalesce({_lookup(m, p)}, "
            f"CASE WHEN regexp_full_match({p}, {q(TX.FLAG_FULL[1:-1])}) "
            f"THEN 'flag_' || translate({p}, {ri}, {az}) "
            f"WHEN regexp_full_match({p}, {q(TX.KEYCAP_FULL[1:-1])}) "
            f"THEN 'keycap_' || substr({p}, 1, 1) "
            f"ELSE {parts} END)")


def demojize(x: str, m: str = "lexm.m") -> str:
    seq_inner = TX.SEQ_FULL[4:-2]  # strip ^(?: and )$
    body = (f"array_to_string(list_transform(regexp_extract_all({x}, {q(TX.PIECES)}, 1), "
            f"lambda p: CASE WHEN regexp_full_match(p, {q(seq_inner)}) "
            f"THEN ' ' || {emoji_name('p', m)} || ' ' ELSE p END), '')")
    return f"CASE WHEN regexp_matches({x}, {q(TX.SEQ)}) THEN {body} ELSE {x} END"


def with_sentinel(stream: str, flag: str) -> str:
    return f"CASE WHEN NOT {flag} THEN {q(L.NO_EMOJI)} ELSE {stream} END"


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(TX.WORD_TOKEN)}, 0)"


def char_text(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(TX.WS_RUN)}, ' ', 'g')"


# --- derived views shared by the oracle queries -----------------------------
def documents_emoji_sql() -> str:
    from mojiframe.sources.tables import EMOJI_SUFFIXES

    cases = " ".join(f"WHEN {i} THEN {chars_literal(s) if s else q('')}"
                     for i, s in enumerate(EMOJI_SUFFIXES))
    return (f"SELECT doc_id AS id, text || (CASE doc_id % {len(EMOJI_SUFFIXES)} {cases} END) AS text, "
            f"lang, source FROM documents")


def corpus_sql() -> str:
    return ("SELECT d.id, d.text, CAST(1 - l.quality AS INTEGER) AS label, "
            "CASE WHEN l.toxic = 1 THEN d.source END AS rephrase "
            f"FROM ({documents_emoji_sql()}) d JOIN labels l ON d.id = l.doc_id")


def variants_sql(src: str, text_col: str = "text") -> str:
    """F13 over a relation ``src`` (needs the ``lexm`` CTE in scope)."""
    t = as_text(text_col)
    return (f"SELECT s.*, {t} AS x_full, "
            f"{with_sentinel(extract_emoji(t), has_emoji(t))} AS x_emoji, "
            f"{has_emoji(t)} AS has_emoji, "
            f"{strip(remove_seq(t))} AS x_text, "
            f"{strip(demojize(t))} AS x_desc "
            f"FROM ({src}) s CROSS JOIN lexm")


def predictions_sql(variants_rel: str) -> str:
    from mojiframe.sources.tables import N_RUNS, PRED_A, PRED_B

    p = f"(CAST(((v.id * {PRED_A} + r.run_no * {PRED_B}) % 1000) AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
    return (f"SELECT 'run_' || CAST(r.run_no AS VARCHAR) AS run, v.*, v.label AS y_true, "
            f"{p} AS p, CAST({p} >= 0.5 AS INTEGER) AS y_pred "
            f"FROM ({variants_rel}) v, (SELECT unnest(range(1, {N_RUNS + 1})) AS run_no) r")


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def runs_sql() -> str:
    """The run-config table in SQL, names built with printf."""
    from mojiframe.sources.runs import RUNS, SHARED

    vals = ", ".join(f"({no}, {q(m)}, {q(c)})" for no, m, c in RUNS)
    lr, ep, bs, seed = SHARED["lr"], SHARED["epochs"], SHARED["batch_size"], SHARED["seed"]
    name = (f"printf('%s_%s_roberta_lr%s_ep%d_bs%d_seed%d', fusion_mode, text_col, "
            f"CASE WHEN {lr!r} < 1e-3 THEN printf('%.0e', {lr!r}) ELSE CAST({lr!r} AS VARCHAR) END, "
            f"{ep}, {bs}, {seed})")
    return (f"SELECT run_no, fusion_mode, text_col, {name} AS run FROM (VALUES {vals}) "
            f"AS t(run_no, fusion_mode, text_col)")


def corpus_variants_sql() -> str:
    return variants_sql(corpus_sql())


def predictions_named_sql(variants_rel: str | None = None) -> str:
    """Predictions of the five runs over the corpus variants (needs lexm)."""
    from mojiframe.sources.tables import N_RUNS, PRED_A, PRED_B

    v = variants_rel or corpus_variants_sql()
    p = f"(CAST(((v.id * {PRED_A} + r.run_no * {PRED_B}) % 1000) AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
    return (f"SELECT r.run, v.*, v.label AS y_true, {p} AS p, CAST({p} >= 0.5 AS INTEGER) AS y_pred "
            f"FROM ({v}) v, ({runs_sql()}) r WHERE r.run_no BETWEEN 1 AND {N_RUNS}")


def split_sql(rel: str, dev_size: float = 0.15, seed: int = 42) -> str:
    """The stratified split in its window form (oracle for SP1)."""
    return f"""
    (WITH b AS (SELECT id, label, md5(concat_ws('-', '{seed}', CAST(id AS VARCHAR))) AS h FROM ({rel})),
    c AS (SELECT label, count(*) AS n_c FROM b GROUP BY label),
    t AS (SELECT sum(n_c) AS n FROM c),
    q0 AS (SELECT c.label, c.n_c, t.n, CAST(t.n AS DOUBLE) - CAST(ceil({float(dev_size)!r} * t.n) AS DOUBLE) AS n_train
           FROM c CROSS JOIN t),
    q1 AS (SELECT *, CAST(n_c AS DOUBLE) / CAST(n AS DOUBLE) * n_train AS cont FROM q0),
    q2 AS (SELECT *, floor(cont) AS base, cont - floor(cont) AS rem FROM q1),
    q3 AS (SELECT *, n_train - sum(base) OVER () AS leftover,
                  row_number() OVER (ORDER BY rem DESC, label) AS rk FROM q2),
    q AS (SELECT label, CAST(n_c - (base + CASE WHEN rk <= leftover THEN 1 ELSE 0 END) AS BIGINT) AS dev_quota FROM q3)
    SELECT b.id, b.label,
           CASE WHEN row_number() OVER (PARTITION BY b.label ORDER BY b.h, b.id) <= q.dev_quota
                THEN 'dev' ELSE 'train' END AS split
    FROM b JOIN q ON b.label = q.label)"""


CONFUSION_SQL = ("count(*) AS n, count_if(y_true = 0 AND y_pred = 0) AS tn, "
                 "count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn, "
                 "count_if(y_true = 1 AND y_pred = 1) AS tp")


def _sdiv(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


def metrics_sql() -> str:
    """G2-G6 from columns tn, fp, fn, tp (same arithmetic as the Spark side)."""
    f0 = _sdiv("2 * tn", "2 * tn + fp + fn")
    f1 = _sdiv("2 * tp", "2 * tp + fp + fn")
    pres0 = "((tn + fp) + (tn + fn)) > 0"
    pres1 = "((tp + fn) + (tp + fp)) > 0"
    macro = (f"coalesce((CASE WHEN {pres0} THEN {f0} ELSE 0.0 END + CASE WHEN {pres1} THEN {f1} ELSE 0.0 END)"
             f" / NULLIF(CAST(CAST({pres0} AS INTEGER) + CAST({pres1} AS INTEGER) AS DOUBLE), 0), 0.0)")
    return ", ".join([
        f"{_sdiv('tn + tp', 'tn + fp + fn + tp')} AS accuracy", f"{macro} AS macro_f1",
        f"{_sdiv('tn', 'tn + fn')} AS p0", f"{_sdiv('tn', 'tn + fp')} AS r0", f"{f0} AS f0",
        "CAST(tn + fp AS DOUBLE) AS s0",
        f"{_sdiv('tp', 'tp + fp')} AS p1", f"{_sdiv('tp', 'tp + fn')} AS r1", f"{f1} AS f1",
        "CAST(tp + fn AS DOUBLE) AS s1",
    ])


def preds_cte() -> str:
    """CTEs ``lexm`` and ``preds`` (the five runs over the corpus)."""
    return f"{lexicon_cte()}, preds AS ({predictions_named_sql()})"


def by_slice_sql(rel: str = "preds") -> str:
    return (f"SELECT run, slice, n, tn, fp, fn, tp, {metrics_sql()} FROM ("
            f"SELECT run, CASE WHEN grouping(has_emoji) = 1 THEN 'all' WHEN has_emoji THEN 'emoji' "
            f"ELSE 'no_emoji' END AS slice, {CONFUSION_SQL} FROM {rel} "
            f"GROUP BY GROUPING SETS ((run), (run, has_emoji)))")
