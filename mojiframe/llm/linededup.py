"""Line de-duplication by content-defined chunks.

Every text is cut into short lines: one starts at every line (after a newline), at every sentence
(after a word that ends in ``.``, ``!`` or ``?``) and inside of sentences at each word whose hash is
lower than those of the words before and after it in the sentence (some three words each), so that text set as one
paragraph, or without any sentence, is a run of lines too.  Each has a hash, and a rolling
hash goes over two line hashes, a line's own and the next one's of its text or long paragraph.

A chunk starts at a line whose rolling hash is lower than those of all lines that start up to
``min_words`` - 1 words before or after it, where those that open a line come first and those that open a sentence
second.  Boundaries so depend on nearby content only and survive insertions elsewhere.
Longer stretches are dealt on from there by the lowest rolling hash among the lines that start at ``min_words`` to 2 ``min_words`` - 1
words (at ``min_words`` words where none does).  Texts and paragraphs of ``paragraph_words``
words or more start and end chunks, so that a repeated one goes whole.

Chunks of ``min_words`` words or more that occur more than
once in the corpus stay at their first place (smallest id, then position) and go
everywhere else, after their bytes have been compared with those of the first place.

Per chunk only (hash, length, row key, span) is shuffled; bytes travel only for
chunks that repeat.  Counting and choosing the first place combine map-side, so a
chunk that a third of all documents hold is one row a task.

Defined results: null stays null, empty stays empty; rows that repeat both id and
text are one place (they stay or go alike); null ids come after all others; of
equal chunks with another hash nothing is lost but the removal; a text whose
chunks all went is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiframe.llm import bitmap
from mojiframe.llm.common import map_text, materialise, named_again, release, slices, text_buffer, text_rows
from mojiframe.llm.words import SPACE_WORDS, Words, mix, span_hashes, split

MIN_WORDS = 10
PARAGRAPH_WORDS = 24

_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _lowest(v: np.ndarray, n: int) -> np.ndarray:
    """The lowest of each ``n`` values in a row."""
    k = 1
    while 2 * k <= n:
        v, k = np.minimum(v[:-k], v[k:]), 2 * k
    return np.minimum(v[:len(v) - (n - k)], v[n - k:]) if n > k else v


def _rolling(w: Words, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Of the short lines that start at the words ``at``: the hash over its own line hash and the next one's;
    at ``fixed`` words it begins anew, so that what is before does not depend on what follows."""
    h = span_hashes(w.data, w.starts[at], w.ends[np.append(at[1:], len(w.starts)) - 1])
    after = np.where(np.append(fixed[at[1:]], True), _U(0), np.append(h[1:], _U(0)))
    return mix(h * _U(0x9E3779B97F4A7C15) + after)


def chunks(raw: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS,
           paragraph_words: int = PARAGRAPH_WORDS) -> tuple[np.ndarray, ...]:
    """Of the chunks that count: row, start and end of the span, end of its bytes
    without trailing white space, hash."""
    w = split(raw, offsets, SPACE_WORDS)
    n, starts, doc = len(w.starts), w.starts, w.doc
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, _U)
    first = np.append(True, doc[1:] != doc[:-1])
    newlines = np.append(0, np.cumsum(raw == 10))[starts]
    line = first | np.append(True, newlines[1:] != newlines[:-1])
    sentence = line | np.append(True, _STOP[raw[w.ends[:-1] - 1]])
    h = w.hashes()
    short = sentence.copy()
    short[1:-1] |= (h[1:-1] < h[:-2]) & (h[1:-1] < h[2:]) & ~sentence[2:]  # a sentence's last word opens none
    paragraph = np.flatnonzero(line)
    long = np.diff(np.append(paragraph, n)) >= paragraph_words
    fixed = first.copy()
    fixed[paragraph[long]] = True
    fixed[paragraph[1:][long[:-1]]] = True
    at = np.flatnonzero(short)
    rank = np.full(n, ~_U(0))
    rank[at] = (_rolling(w, at, fixed) >> _U(2)) + np.where(line[at], _U(1), np.where(sentence[at], _U(1 << 62), _U(2 << 62)))
    rank[fixed] = 0
    edge = np.zeros(2 * min_words, _U)
    wide = np.concatenate([edge, rank, edge])       # texts end at a 0 on either side
    if min_words > 1:
        low = _lowest(wide, min_words - 1)
        cut = fixed | ((rank < low[min_words + 1:min_words + 1 + n]) & (rank < low[2 * min_words + 1:2 * min_words + 1 + n]))
    else:
        cut = np.ones(n, bool)
    at = np.flatnonzero(cut)
    stop = np.append(at[1:], n)
    while len(at):                                  # a step further in every stretch that is left
        more = stop - at >= 2 * min_words
        at, stop = at[more] + min_words, stop[more]
        at = at + np.argmin(wide[(at + 2 * min_words)[:, None] + np.arange(min_words)], axis=1)
        more = at <= stop - min_words
        at, stop = at[more], stop[more]
        cut[at] = True
    at = np.flatnonzero(cut)
    stop = np.append(at[1:], n)
    begin = np.where(first, offsets[doc], starts)
    ends = np.append(begin[1:], len(raw))
    ends = np.where(np.append(first[1:], True), offsets[doc + 1], ends)
    opens = np.append(line, True)
    end = np.where(opens[stop] & ~line[at], w.ends[stop - 1], ends[stop - 1])  # what comes before stays a line
    keep = stop - at >= min_words
    at, stop, end = at[keep], stop[keep], end[keep]
    return doc[at], begin[at], end, w.ends[stop - 1], span_hashes(raw, begin[at], w.ends[stop - 1])


def _occurrences(rows: DataFrame, params: tuple[int, int], wanted=None) -> DataFrame:
    """h, size, id, key, a, b (span) of the chunks; with ``wanted``, a bitmap, only those it may hold, and their bytes."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["h", "size", "id", "key", "a", "b"] + ["bytes"] * (wanted is not None)

    def run(batches):
        for big in batches:
            for b in slices(big, "text"):
                raw, offsets = text_buffer(b.column(1))
                doc, start, end, last, h = chunks(raw, offsets, *params)
                h = h.view(np.int64)
                if wanted is not None:
                    keep = bitmap.holds(wanted.value, h)
                    doc, start, end, last, h = (x[keep] for x in (doc, start, end, last, h))
                row = pa.array(doc)
                out = [pa.array(h), pa.array(last - start), b.column(0).take(row), b.column(2).take(row),
                       pa.array(start - offsets[doc]), pa.array(end - offsets[doc])]
                if wanted is not None:
                    view = raw.tobytes()
                    out.append(pa.array([view[s:e] for s, e in zip(start.tolist(), last.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, f"h long, size long, id {kind}, key long, a long, b long" + ", bytes binary" * (wanted is not None))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                min_words: int = MIN_WORDS, paragraph_words: int = PARAGRAPH_WORDS) -> DataFrame:
    """One row per document: id, text without the chunks that went, n_removed (chunks),
    removed_bytes, and the columns ``keep``."""
    params = (min_words, paragraph_words)
    rows = text_rows(docs, id_col, text_col, keep).withColumn("key", F.xxhash64("text"))
    short = rows.select("id", "text", "key")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "a")
    found = _occurrences(short, params).groupBy("h", "size").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialise(found.where("first != last").select("h", "size", "first"), "repeated")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap.build(repeated, F.col("h")))
    own = _occurrences(short, params, wanted).join(repeated, ["h", "size"])
    own = materialise(own.withColumn("place", place), "chunk-bytes")
    at_first = own.where("place = first").select("h", "size", F.col("bytes").alias("kept")).dropDuplicates(["h", "size"])
    gone = own.where("place != first").join(at_first, ["h", "size"]).where("bytes = kept")
    spans = gone.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))  # chunks of one text
    cut = rows.join(spans.withColumnRenamed("id", "sid").withColumnRenamed("key", "skey"),
                    F.col("id").eqNullSafe(F.col("sid")) & (F.col("key") == F.col("skey")), "left").drop("sid", "skey", "key")

    def make():
        def run(b: pa.RecordBatch) -> list[pa.Array]:
            texts, sizes, counts = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(b.schema.get_field_index("spans")).to_pylist()):
                if spans:
                    raw, at, left = t.encode("utf-8"), 0, []
                    for s in spans:
                        left.append(raw[at:s["a"]])
                        at = s["b"]
                    t = b"".join([*left, raw[at:]]).decode("utf-8").rstrip("\n")
                texts.append(t)
                counts.append(len(spans or ()))
                sizes.append(sum(s["b"] - s["a"] for s in spans or ()))
            return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]

        return run

    out = map_text(cut, make, "new_text string, n_removed long, removed_bytes long")
    out = materialise(named_again(out, id_col, keep, F.col("new_text").alias(text_col), "n_removed", "removed_bytes"), "deduplicated")
    release(repeated, own)
    return out


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
