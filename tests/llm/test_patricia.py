"""Exact de-duplication by tries, against grouping of normalised texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from mojiframe.llm import catalog
from mojiframe.llm.patricia import Node, Trie, normalised, trie_dedup

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    """[(id, keep_id, group_size, sha)] and the number of kept rows a group."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, min(known) if known else None, len(ids), sha) for i in ids]
    return sorted(out, key=repr), len(groups)


def check(df, rows):
    got = [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
    want, groups = plain(rows)
    assert sorted([g[:4] for g in got], key=repr) == want
    kept = [g for g in got if g[4]]
    assert len(kept) == groups == len({g[3] for g in kept})
    assert all(g[0] == g[1] for g in kept)


@pytest.mark.parametrize("folder", ["edge", SMALL])
def test_query(spark, request, read, folder):
    folder = request.getfixturevalue(folder) if folder == "edge" else folder
    check(catalog.queries()["op13_patricia_dedup"](spark, folder), read(folder, "documents", "doc_id", "text"))


@pytest.mark.parametrize("trie_bytes", [3_000, 30_000])
def test_spilled_subtrees_lose_nothing(spark, read, edge, trie_bytes):
    docs = spark.read.parquet(f"{edge}/documents.parquet").repartition(5)
    check(trie_dedup(docs, trie_bytes=trie_bytes), read(edge, "documents", "doc_id", "text"))


def test_hot_group_and_text_ids(spark):
    rows = [(f"d{i:04}", "the same  text" if i % 3 else f"own {i}") for i in range(900)] + [("x", "the same\ttext "), ("y", "the same text")]
    check(trie_dedup(spark.createDataFrame(rows, "doc_id string, text string").repartition(7)), rows)


def test_extra_columns_are_carried(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    out = trie_dedup(docs, keep=("lang", "node", "n"))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "lang", "node", "n"]
    assert sorted(map(repr, out.select("doc_id", "lang", "node").collect())) == sorted(map(repr, docs.select("doc_id", "lang", "node").collect()))


def test_trie_holds_prefixes_and_spills_by_branch():
    rng = random.Random(3)
    texts = {bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)} | {b"", b"a" * 5000, b"a" * 5000 + b"b"}
    trie = Trie()
    for t in [*texts, *texts]:
        trie.find(t).owner = t
    trie.texts = len(texts)
    assert [t for t, _ in Trie.owners(trie.root)] == sorted(texts)
    assert all(t == own for t, own in Trie.owners(trie.root))
    gone = dict(trie.spill(trie.bytes // 2, stubs=True))
    left = dict(Trie.owners(trie.root))
    assert gone and left and set(gone) | set(left) == texts and not set(gone) & set(left)
    assert all(trie.find(t) is None for t in gone) and all(trie.find(t).owner == t for t in left)
    assert isinstance(trie.find(b"c"), Node)


def test_normalised():
    assert normalised(b" a\t\n b\r\n\x0b\x0cc  \xc2\xa0 ") == b" a b c \xc2\xa0 "
    assert normalised(None) == b""
