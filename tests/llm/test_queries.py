"""Every query of the subpackage on the edge tables, on tables without rows and
on the smallest generated tables, against plain versions."""

import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from mojiframe.llm import catalog, ngramlm

from . import brute

SMALL = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]


def result(spark, name, folder, *columns):
    return [tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, hollow, name):
    assert QUERIES[name](spark, hollow).count() == 0


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()}
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("folder", ["edge", SMALL])
def test_url_filter(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "edge" else folder
    got = QUERIES["op1_url_filter"](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.execute(catalog.oracle_sql()["op1_url_filter"])
    names = [d[0] for d in want.description]
    same([tuple(r) for r in got.select(*names).collect()], want.fetchall())


def test_url_filter_intervals(spark):
    from mojiframe.llm.urlfilter import filter_urls

    day = 86_400
    entries = spark.createDataFrame(
        [("l", "block", "domain", "bad.org", 10, "add"), ("l", "block", "domain", "bad.org", 20, "remove"), ("l", "block", "domain", "bad.org", 40, "add"),
         ("l", "block", "domain", "bad.org", 40, "remove"), ("l", "block", "domain", "bad.org", 200, "add"),
         ("w", "allow", "prefix", "x.bad.org/ok", 0, "add"), ("w", "allow", None, "bad.org", 0, "add")],
        "list string, policy string, kind string, pattern string, day long, action string")
    urls = [(d, f"http://x.bad.org/{p}", d * day + 5) for d in (9, 10, 19, 20, 40, 199, 200, 500) for p in ("ok/1", "no")]
    got = filter_urls(spark.createDataFrame(urls, "page_id long, url string, fetched long"), entries).collect()
    for r in got:
        listed = 10 <= r.page_id < 20 or r.page_id >= 200
        want = "allow" if r.url.endswith("ok/1") else "block" if listed else "none"
        assert (r.verdict, r.n_active) == (want, listed + r.url.endswith("ok/1")), r


def test_quality(spark, edge, read):
    rows = result(spark, "op2_compression_quality", edge, "doc_id", "held_out", "score", "predicted")
    assert Counter(r[0] for r in rows) == Counter(r[0] for r in read(edge, "documents", "doc_id"))
    for i, held, score, predicted in rows:
        assert held == (None if i is None else brute.crc_mod(i, 5) == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.3)


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.execute(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    rows = [(s, labels[i]) for i, held, s in result(spark, "op2_compression_quality", folder, "doc_id", "held_out", "score") if held and i in labels]
    s, y = np.array(rows).T
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(len(s))
    assert (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum()) > 0.98
    assert ((s >= 0.3) == y).mean() > 0.93


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, edge, read, order):
    from pyspark.sql import functions as F

    from mojiframe.llm.common import crc_mod

    docs = read(edge, "documents", "doc_id", "text")
    lm = brute.Lm(docs, [brute.crc_mod(i, 7) not in (None, 2) for i, _ in docs], order, ngramlm.MU, ngramlm.POWER, ngramlm.MIN_CONTEXT, ngramlm.STEP)
    want = sorted(((i, *r) for (i, _), r in zip(docs, lm.rows())), key=key)
    got = ngramlm.score_texts(spark.read.parquet(f"{edge}/documents.parquet"), crc_mod(F.col("doc_id"), 7) != 2, order=order)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6)
        assert a[5] == pytest.approx(b[5], abs=2 * ngramlm.STEP * a[1] ** 0.5)  # a rounding may fall either way


def test_language_model_beats_unigrams_on_held_out_texts(spark):
    rows = result(spark, "op3_ngram_lm", "/root/testdata/sf0.01", "held_out", "n_tokens", "base_score", "score")
    n, base, score = (sum(r[k] for r in rows if r[0]) for k in (1, 2, 3))
    assert score / n > base / n + 0.1


def test_warc(spark, edge, read):
    pages = read(edge, "pages", "page_id", "html")
    first = {}
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, html in pages:
        data, low = (html or "").encode(), first.get(html or "")
        kind = i == low or low is None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if kind else "revisit", None if kind else low))
    same(result(spark, "op4_warc_salvage", edge, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), want)


def _exact_neighbours(rows, k=20):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        own = sorted(((-float(np.dot(v, x)), i) for i, x in good if i != q and len(x) == len(v)))[:k]
        yield q, [(-s, i) for s, i in own]


@pytest.mark.parametrize("folder", ["edge", "/root/testdata/sf0.1"])
def test_nearest(spark, request, read, folder):
    folder = request.getfixturevalue(folder) if folder == "edge" else folder
    got = {}
    for q, rank, i, score in sorted(result(spark, "op5_collision_search", folder, "query_id", "rank", "vec_id", "score")):
        assert rank == len(got.setdefault(q, [])) + 1
        got[q].append((score, i))
    want = {q: v for q, v in _exact_neighbours(read(folder, "embeddings", "vec_id", "embedding")) if v}
    assert got.keys() == want.keys()
    recall = []
    for q, best in want.items():
        assert len(got[q]) == len(best) and got[q] == sorted(got[q], key=lambda x: (-x[0], x[1]))
        recall.append(sum(s >= best[-1][0] - 1e-9 for s, _ in got[q]) / len(best))
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("folder", ["edge", SMALL])
def test_jaccard(spark, request, read, folder):
    folder = request.getfixturevalue(folder) if folder == "edge" else folder
    want = brute.jaccard(read(folder, "documents", "doc_id", "text"))
    same(result(spark, "op6_jaccard_join", folder, "doc_id", "n_shingles", "component_id", "n_links"), want)


def test_jaccard_in_blocks(spark, edge, read):
    from mojiframe.llm.setjoin import jaccard_components

    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for n, num, block, hot in ((5, 80, 4, 10), (1, 60, 3, 0), (3, 100, 1024, 1 << 18)):
        got = [tuple(r) for r in jaccard_components(docs, n=n, num=num, block=block, hot=hot).collect()]
        same(got, brute.jaccard(read(edge, "documents", "doc_id", "text"), n, num))


def test_decontaminate(spark, edge, read):
    want = brute.decontaminate(read(edge, "documents", "doc_id", "text"), read(edge, "benchmark", "item_id", "text"))
    same(result(spark, "op8_decontaminate", edge, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_decontaminate_in_blocks(spark, edge):
    from mojiframe.llm.decontaminate import find_contamination

    docs, items = (spark.read.parquet(f"{edge}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = ([tuple(r) for r in find_contamination(docs, items, block_words=b, keep=("lang",)).collect()] for b in (1 << 20, 40))
    same(one, many)


def test_bpe(spark, edge, read):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in read(edge, "documents", "doc_id", "text"):
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same(result(spark, "op9_byte_bpe", edge, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_language(spark, edge, read):
    rows = result(spark, "op10_language_id", edge, "doc_id", "held_out", "lang_pred", "score")
    texts = read(edge, "documents", "doc_id", "text")
    assert Counter(r[0] for r in rows) == Counter(t[0] for t in texts)
    assert sum(r[2] == "und" for r in rows) == sum(not any(c.isalpha() for c in t or "") for _, t in texts)
    for i, held, lang, score in rows:
        assert held == (None if i is None else brute.crc_mod(i, 4) == 2)
        assert lang in ("en", "de", "und") and 0 <= score <= 1 and (lang != "und" or score == 0)


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = dict(duckdb.execute(f"select doc_id, lang from '{folder}/documents.parquet'").fetchall())
    rows = [langs[i] == lang for i, held, lang in result(spark, "op10_language_id", folder, "doc_id", "held_out", "lang_pred") if held]
    assert np.mean(rows) > 0.97


def test_oracles(spark):
    """The SQL of each query gives its rows."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in catalog.oracle_sql().items():
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        got = QUERIES[name](spark, SMALL)
        assert sorted(names) == sorted(got.columns)
        same([tuple(r) for r in got.select(*names).collect()], want.fetchall())
