"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern ("window") is ``window`` consecutive words of a benchmark item; an
item with fewer words, but not none, is one shorter window.  For each window
length there is one matcher:

* a SHIFT table indexed by the hash of a block of two words: how far the scan
  may jump when it sees this block (the largest jump for unknown blocks);
* where the shift is 0, the hash of the last words of the position selects a
  bucket of patterns, a hash of the whole window thins them;
* the words of what is left are compared directly, byte by byte.

The scan runs over many segments of a batch in lockstep, so that every step
is one numpy operation.  Documents are never shuffled: the patterns travel, as
broadcasts of at most ``BLOCK_WORDS`` benchmark words each.  A larger benchmark
is searched block after block over the same rows, with the results merged in
the row, so no size of benchmark loses a pattern.

Defined results: null or empty text has no words and no hits; repeated rows
give a row each; items with null text or without words have no windows; rows
of equal item id count as one item; no benchmark rows: nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiframe.llm.common import map_text, named_again, narrow, slices, text_buffer, text_rows
from mojiframe.llm.words import ALNUM_WORDS, mix, ngram_hashes, split

WINDOW = 10
BLOCK_WORDS = 1 << 20   # benchmark words in one broadcast: about 20 MB
PIECE_WORDS = 4096      # long items are cut into pieces that overlap by window - 1
SEGMENT = 512
SUFFIX = 4

_U = np.uint64


class WuManber:
    """Patterns are runs of ``m`` words of the array ``words``, by start position."""

    def __init__(self, words: list[bytes], hashes: np.ndarray, starts: np.ndarray, items: np.ndarray, m: int):
        self.m, self.words = m, words
        self.block = min(2, m)
        whole = ngram_hashes(hashes, m)[starts]
        # equal windows are one pattern with several items
        order = np.lexsort((items, whole))
        keep = np.ones(len(order), bool)
        keep[1:] = whole[order][1:] != whole[order][:-1]
        for i in np.flatnonzero(~keep).tolist():  # equal hashes: the words decide
            a, b = int(starts[order[i - 1]]), int(starts[order[i]])
            keep[i] = words[a:a + m] != words[b:b + m]
        self.whole = whole[order][keep]
        self.start = starts[order][keep]
        self.item_ptr = np.append(np.flatnonzero(keep), len(order))
        self.items = items[order]
        blocks = ngram_hashes(hashes, self.block)
        size = 1 << max(10, int(8 * len(starts) * m).bit_length())
        self.mask = _U(min(size, 1 << 24) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.block + 1, np.uint16)
        for j in range(m - self.block + 1):  # block that starts at word j of the window
            np.minimum.at(self.shift, (blocks[self.start + j] & self.mask).astype(np.int64), m - self.block - j)
        suffix = ngram_hashes(hashes, s := min(m, SUFFIX))[self.start + m - s]
        self.by_suffix = np.lexsort((self.whole, suffix))
        self.suffix = suffix[self.by_suffix]
        ranked = self.whole[self.by_suffix]
        self.twin = np.append(ranked[1:] == ranked[:-1], False)  # other words of the same hash follow

    def find(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and pattern numbers of all matches; words still to be compared."""
        m, n, none = self.m, len(h), np.zeros(0, np.int64)
        if n < m:
            return none, none
        pos = np.arange(m - 1, n, SEGMENT)  # last word of the window
        end = np.minimum(pos + SEGMENT, n)
        stops = []
        while len(pos):
            key = np.zeros(len(pos), _U)
            for i in range(self.block):
                key = mix(key * _U(0x9FB21C651E98DF25) + h[pos - self.block + 1 + i] + _U(i + 1))
            jump = self.shift[(key & self.mask).astype(np.int64)].astype(np.int64)
            stops.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        at = np.concatenate(stops) - m + 1
        at = at[doc[at] == doc[at + m - 1]]
        if not len(at):
            return none, none
        s = min(m, SUFFIX)
        key, whole = np.zeros(len(at), _U), np.zeros(len(at), _U)
        for i in range(s):
            key = mix(key * _U(0x9FB21C651E98DF25) + h[at + m - s + i] + _U(i + 1))
        lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        for i in range(m):
            whole = mix(whole[:len(at)] * _U(0x9FB21C651E98DF25) + h[at + i] + _U(i + 1)) if i else mix(h[at] + _U(1))
        found_at, found = [], []
        step = 0
        while len(at):  # the k-th pattern of every bucket at once
            pat = self.by_suffix[lo + step]
            hit = self.whole[pat] == whole
            found_at.append(at[hit])
            found.append(pat[hit])
            step += 1
            live = (lo + step < hi) & (~hit | self.twin[lo + step - 1])  # equal windows are one pattern
            at, lo, hi, whole = at[live], lo[live], hi[live], whole[live]
        return np.concatenate(found_at) if found_at else none, np.concatenate(found) if found else none


class Patterns:
    """All matchers of one block of the benchmark."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        words: list[bytes] = []
        ids: dict[str, int] = {}
        starts: dict[int, list[int]] = {}
        items: dict[int, list[int]] = {}
        for item, text in rows:
            w = text.encode("utf-8").split(b" ")
            m, base = min(window, len(w)), len(words)
            words += w
            k = ids.setdefault(item, len(ids))
            starts.setdefault(m, []).extend(range(base, base + len(w) - m + 1))
            items.setdefault(m, []).extend([k] * (len(w) - m + 1))
        self.names = list(ids)
        joined = np.frombuffer(b" ".join(words) or b" ", np.uint8)
        sp = split(joined, np.array([0, len(joined)]), ALNUM_WORDS)
        self.matchers = [WuManber(words, sp.hashes(), np.array(starts[m]), np.array(items[m]), m) for m in sorted(starts)]


def _scan(w, h: np.ndarray, p: Patterns, hit: np.ndarray, seen: list[set]) -> None:
    for wm in p.matchers:
        at, pat = wm.find(h, w.doc)
        ok = np.zeros(len(at), bool)
        for k, (a, q) in enumerate(zip(at.tolist(), pat.tolist())):
            b = int(wm.start[q])
            ok[k] = all(w.word(a + i) == wm.words[b + i] for i in range(wm.m))
        at, pat = at[ok], pat[ok]
        edge = np.zeros(len(hit) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + wm.m, -1)
        hit |= np.cumsum(edge[:-1]) > 0
        for d, q in set(zip(w.doc[at].tolist(), pat.tolist())):
            seen[d].update(p.names[i] for i in wm.items[wm.item_ptr[q]:wm.item_ptr[q + 1]].tolist())


def item_pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, text): normalised words, at most PIECE_WORDS of an item in a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                w = split(*text_buffer(b.column(1)), ALNUM_WORDS)
                out: list[tuple[str, str]] = []
                for i, item in enumerate(b.column(0).to_pylist()):
                    own = [w.word(k).decode("utf-8") for k in range(w.first[i], w.first[i + 1])]
                    step = PIECE_WORDS - window + 1
                    out += [(item, " ".join(own[k:k + PIECE_WORDS])) for k in range(0, max(1, len(own) - window + 1), step) if own]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["item", "text"])

    items = narrow(benchmark, item=item_col, text=text_col).where(F.col("item").isNotNull())
    return items.select(F.col("item").cast("string"), "text").mapInArrow(cut, "item string, text string").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (sorted ids of the
    benchmark items with a window in it), spans (start, end pairs of hit
    words, flat) and the columns ``keep``."""
    spark = docs.sparkSession
    pieces = item_pieces(benchmark, item_col, item_text_col, window).cache()
    total = pieces.select(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_words))  # hashed blocks stay below the bound at twice the mean
    out = text_rows(docs, id_col, text_col, keep).withColumns({
        "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for k in range(n_blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Patterns([(r[0], r[1]) for r in rows], window))
        out = map_text(out.withColumnsRenamed({"spans": "spans_before", "items": "items_before"}), _searcher(shared),
                       "n_words long, spans array<int>, items array<string>").drop("spans_before", "items_before")
        out = out.drop("n_words") if k < n_blocks - 1 else out
    pieces.unpersist()
    return named_again(out, id_col, keep, "n_words", _covered("spans").alias("n_hit"), F.sort_array("items").alias("items"), "spans")


def _covered(spans: str):
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def _searcher(shared):
    def make():
        p = shared.value

        def search(b: pa.RecordBatch) -> list[pa.Array]:
            w = split(*text_buffer(b.column(1)), ALNUM_WORDS)
            hit = np.zeros(len(w.starts), bool)
            seen: list[set] = [set(x) for x in b.column("items_before").to_pylist()]
            for i, spans in enumerate(b.column("spans_before").to_pylist()):  # hits of earlier blocks
                for s, e in zip(spans[::2], spans[1::2]):
                    hit[w.first[i] + s:w.first[i] + e] = True
            _scan(w, w.hashes(), p, hit, seen)
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1] | (w.doc[1:] != w.doc[:-1])
            closes[:-1] &= ~hit[1:] | (w.doc[1:] != w.doc[:-1])
            s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            row = w.doc[s]
            flat = np.stack([s - w.first[row], e - w.first[row]], 1).ravel().astype(np.int32)
            ptr = 2 * np.searchsorted(row, np.arange(b.num_rows + 1))
            return [pa.array(np.diff(w.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(flat)),
                    pa.array([sorted(x) for x in seen], pa.list_(pa.string()))]

        return search

    return make


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                               spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
