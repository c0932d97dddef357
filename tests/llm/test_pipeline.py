"""The pipeline stage by stage and whole, against plain versions."""

import base64
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from mojiframe.llm import langid, linededup

from . import brute

STAGES = dict(pipeline.STAGES)


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def dedup_lines(docs, keys):
    """[(id, text, removed)] for docs in any order; keys: the hash of each text."""
    seen, out = {}, {}
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, keys[k] or 0)):
        raw = (docs[k][1] or "").encode()
        place, at, left, gone = (docs[k][0], keys[k]), 0, [], 0
        for a, b, c in brute.line_chunks(raw.decode()):
            if seen.setdefault(raw[a:c], (place, a)) != (place, a):
                left.append(raw[at:a])
                at, gone = b, gone + 1
        text = b"".join([*left, raw[at:]]).decode()
        out[k] = (docs[k][0], text.rstrip("\n") if gone else docs[k][1], gone)
    return [out[k] for k in range(len(docs))]


def keyed(df):
    got = df.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()
    return [(r.doc_id, r.text) for r in got], [r.k for r in got]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "decontamination", "byte-level BPE"]


def test_language_stage(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    found = langid.identify_language(docs, langid.train(docs), keep=("text",)).collect()
    want = [(r.doc_id, r.text) for r in found if r.lang_pred != "und" and r.score >= pipeline.MIN_LANGUAGE_SCORE]
    got = STAGES["language ID"](spark, docs, edge)
    assert got.columns == pipeline.COLUMNS
    same(rows(got), want)
    assert {t for _, t in want} >= {t for _, t in rows(docs) if t and len(t) > 100 and " " in t}  # clean texts stay


def test_line_dedup_query(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    want = dedup_lines(*keyed(docs))
    got = linededup.op7_line_dedup(spark, edge).select("doc_id", "text", "n_removed").collect()
    same([tuple(r) for r in got], want)
    assert sum(w[2] for w in want) > 10


def test_passages_of_fifty_words_stay_once(spark, edge):
    got = rows(STAGES["line dedup"](spark, spark.read.parquet(f"{edge}/documents.parquet"), edge))
    lines = [x for _, t in got for x in (t or "").split("\n") if len(x.split()) > 50 and not x.startswith("word word")]
    assert len(lines) == len(set(lines))


def test_near_duplicate_stage(spark, edge):
    docs = rows(spark.read.parquet(f"{edge}/documents.parquet"))
    own = brute.jaccard(docs, 5, 80, 100)
    gone = {i for i, _, low, _ in own if i is not None and low != i}
    got = STAGES["n-gram Jaccard join"](spark, spark.read.parquet(f"{edge}/documents.parquet"), edge)
    assert got.columns == pipeline.COLUMNS
    same(rows(got), [d for d in docs if d[0] not in gone])


def test_decontamination_stage(spark, edge, read):
    docs = rows(spark.read.parquet(f"{edge}/documents.parquet"))
    hit = brute.decontaminate(docs, read(edge, "benchmark", "item_id", "text"))
    same(rows(STAGES["decontamination"](spark, spark.read.parquet(f"{edge}/documents.parquet"), edge)), [d for d, h in zip(docs, hit) if not h[5]])


def test_whole_pipeline(spark, edge, read):
    import public_tokenizers
    import tiktoken

    docs = STAGES["language ID"](spark, spark.read.parquet(f"{edge}/documents.parquet"), edge)
    kept = [(i, t) for i, t, gone in dedup_lines(*keyed(docs)) if not gone or t.strip(" ")]
    own = brute.jaccard(kept, 5, 80, 100)
    low = {i for i, _, c, _ in own if i is not None and c != i}
    kept = [d for d in kept if d[0] not in low]
    kept = [d for d, h in zip(kept, brute.decontaminate(kept, read(edge, "benchmark", "item_id", "text"))) if not h[5]]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in kept:
        ids = bpe.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = pipeline.run(spark, edge).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    same([tuple(r) for r in got], want)


def test_pipeline_without_rows(spark, hollow):
    assert pipeline.run(spark, hollow).count() == 0
