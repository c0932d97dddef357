"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import wraps

from mojiframe.llm import annsearch, bpe, collocations, decontaminate, heapcluster, langid, linededup, ngramlm, oracles, patricia, quality, setjoin, urlfilter, warc
from mojiframe.llm.common import ship

QUERIES = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_compression_quality": quality.op2_compression_quality,
    "op3_ngram_lm": ngramlm.op3_ngram_lm,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_collision_search": annsearch.op5_collision_search,
    "op6_jaccard_join": setjoin.op6_jaccard_join,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_language_id": langid.op10_language_id,
    "op11_heap_clusters": heapcluster.op11_heap_clusters,
    "op12_quotient_phrases": collocations.op12_quotient_phrases,
    "op13_patricia_dedup": patricia.op13_patricia_dedup,
}

SQL: dict[str, str] = {
    "op1_url_filter": urlfilter.SQL,
    "op6_jaccard_join": oracles.JACCARD,
    "op8_decontaminate": oracles.DECONTAMINATE,
    "op11_heap_clusters": heapcluster.SQL,
    "op12_quotient_phrases": collocations.SQL,
    "op13_patricia_dedup": patricia.SQL,
}


def _shipped(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
