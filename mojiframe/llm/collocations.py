"""Phrases of words that stand together, counted in quotient filters (operator 12).

1. Tasks read texts, split them into pieces and words and write them in chunks
   of one language: the stream of local word numbers with a zero at every
   break, and the chunk's own words with their counts.  Shards of words add these
   up and answer each chunk with the numbers of its frequent words, so the
   vocabulary is never broadcast and a row is never a single word.
2. For 2, 3, ... words: a phrase can be frequent only if both its parts of one
   word less are.  Where they are, the number of the first part and that of the last
   word are packed into one integer, permuted, and counted per chunk in counting
   quotient filters, cut by the leading bits into shards.  A shard merges its sorted
   filters, keeps what reaches ``min_count`` (exact counts; the permutation is undone to
   name the phrase) and answers every chunk with the numbers of its phrases that stay.
   Chunks with their answers are the input of the next size.
3. The phrases left are few: joins on narrow rows find the counts of both sides of
   every cut, scores in decimals, cover by longer phrases, and the ranks: first within
   parts of a language, then over what is left of these.

Nothing is approximate and nothing is dropped but what cannot be a result.

Defined results: null texts are empty, a null language is ``und``; repeated rows
count each; extra columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mojiframe.llm import quotient
from mojiframe.llm.common import give_back, materialise, release, slices, text_buffer, text_rows
from mojiframe.llm.words import separators, span_hashes, split

#: Characters that end a piece, and all that end a word.
PIECE = separators((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
WORD = PIECE | separators((0x20, 0x20), (0x09, 0x09))
#: Word bytes that a task holds before it writes a chunk.
CHUNK_BYTES = 16 << 20
#: Occurrences that a shard is planned for.
SHARD_ITEMS = 2 << 20

_U = np.uint64
CHUNK = "kind int, chunk long, lang string, n long, tokens binary, words binary, sizes binary, counts binary"
WORDS = "lang string, shard int, chunk long, words binary, sizes binary, counts binary, locals binary"
NUMBERS = "kind int, chunk long, lang string, word string, id long, n long, locals binary, ids binary"
STREAM = "kind int, chunk long, lang string, grams binary, last binary, shard int, filter binary"
ANSWER = "kind int, chunk long, lang string, shard int, answer binary, gram long, key decimal(20,0), n long"


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(memoryview(data)[8:], size, codec="zstd", asbytes=True) if size else b""


def _dump(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte of equal weight, of which the high ones press well."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + _pack(planes.T.tobytes())


def _load(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").ravel()


def _strings(data: bytes, sizes: np.ndarray) -> pa.Array:
    """Words from their bytes one after the other."""
    places = np.append(0, np.cumsum(sizes.astype(np.int64)))
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(data)])


def _bytes(words: pa.Array) -> tuple[bytes, np.ndarray]:
    raw, offsets = text_buffer(words)
    return raw.tobytes(), np.diff(offsets)


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}
    fields = [f.strip().split(" ") for f in ddl.replace("(20,0)", "(20;0)").split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, types[kind.replace(";", ",")]) for (name, kind), c in zip(fields, columns)})


def _chunks(docs: DataFrame, text_col: str, lang_col: str, chunk_bytes: int) -> DataFrame:
    """Rows of kind 0, a chunk's stream, and of kind 1, its words and their counts."""
    rows = text_rows(docs, lang_col, text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("und")).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held, size = defaultdict(list), defaultdict(int)

        def chunk(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            words = pa.chunked_array([w for w, _ in held[lang]]).dictionary_encode().combine_chunks()
            if isinstance(words, pa.ChunkedArray):
                words = words.chunk(0)
            starts = np.concatenate([s for _, s in held.pop(lang)])
            del size[lang]
            local = words.indices.to_numpy().astype(np.int64)
            counts = np.bincount(local, minlength=len(words.dictionary))
            order = np.argsort(-counts, kind="stable")  # frequent words have small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            stream = np.insert(place[local] + 1, np.flatnonzero(starts), 0)
            data, sizes = _bytes(words.dictionary.take(pa.array(order)))
            number, made = base + made, made + 1
            yield from _table(CHUNK, [(0, number, lang, len(local), _dump(stream), None, None, None),
                                      (1, number, lang, len(counts), None, _pack(data), _dump(sizes), _dump(counts[order]))]).to_batches()

        for big in batches:
            for b in slices(big, "text"):
                b = b.take(pc.sort_indices(b.column(0)))
                raw, offsets = text_buffer(b.column(1))
                w = split(raw, offsets, WORD)
                inside = w.data[~WORD[w.data]]
                length = np.append(0, np.cumsum(w.ends - w.starts))
                piece = np.cumsum(PIECE[raw], dtype=np.int64)[w.starts] if len(w.starts) else w.starts
                starts = np.append(True, (piece[1:] != piece[:-1]) | (w.doc[1:] != w.doc[:-1]))[:len(w.starts)]
                langs = b.column(0).to_pylist()
                cuts = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
                for i, j in zip(cuts, cuts[1:]):
                    x, y = int(w.first[i]), int(w.first[j])
                    if x == y:
                        continue
                    part = inside[length[x]:length[y]]
                    places = (length[x:y + 1] - length[x]).astype(np.int64)
                    words = pa.Array.from_buffers(pa.large_string(), y - x, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(part))])
                    held[langs[i]].append((words, starts[x:y]))
                    size[langs[i]] += len(part)
                while sum(size.values()) >= chunk_bytes:
                    yield from chunk(max(size, key=size.get))
        for lang in sorted(held):
            yield from chunk(lang)
        give_back()

    return rows.mapInArrow(run, CHUNK)


def _word_requests(chunks: DataFrame, bits: int) -> DataFrame:
    """The words of each chunk, cut by their hash into shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lang, data, sizes, counts in zip(*[c.to_pylist() for c in b.columns]):
                words, counts = _strings(_unpack(data), _load(sizes)), _load(counts)
                raw, offsets = text_buffer(words)
                shard = (span_hashes(raw, offsets[:-1], offsets[1:]) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(counts), np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(shard[order]) > 0))
                rows = []
                for i, j in zip(cut, [*cut[1:], len(order)]):
                    own = order[i:j]
                    text, length = _bytes(words.take(pa.array(own)))
                    rows.append((lang, int(shard[own[0]]), chunk, _pack(text), _dump(length), _dump(counts[own]), _dump(own + 1)))
                yield from _table(WORDS, rows).to_batches()

    return chunks.select("chunk", "lang", "words", "sizes", "counts").mapInArrow(run, WORDS)


def _word_numbers(requests: DataFrame, bits: int, min_count: int) -> DataFrame:
    """Kind 0: the frequent words of a language and their numbers, the most frequent first; kind 1: those of a chunk."""
    def run(table: pa.Table) -> pa.Table:
        lang, shard = table["lang"][0].as_py(), table["shard"][0].as_py()
        lists = [_strings(_unpack(w.as_py()), _load(s.as_py())) for w, s in zip(table["words"], table["sizes"])]
        words = pa.chunked_array(lists).dictionary_encode().combine_chunks()
        if isinstance(words, pa.ChunkedArray):
            words = words.chunk(0)
        at = words.indices.to_numpy().astype(np.int64)
        total = np.zeros(len(words.dictionary), np.int64)
        np.add.at(total, at, np.concatenate([_load(c.as_py()) for c in table["counts"]]).astype(np.int64))
        order = np.argsort(-total, kind="stable")
        order = order[total[order] >= min_count]
        number = np.zeros(len(total), np.int64)
        number[order] = (np.arange(len(order)) << bits) + shard + 1
        rows = [(0, None, lang, w, i, n, None, None)
                for w, i, n in zip(words.dictionary.take(pa.array(order)).to_pylist(), number[order].tolist(), total[order].tolist())]
        pos = 0
        for chunk, own, held in zip(table["chunk"].to_pylist(), table["locals"], lists):
            ids, local = number[at[pos:pos + len(held)]], _load(own.as_py())
            pos += len(held)
            if ids.any():
                rows.append((1, chunk, lang, None, None, None, _dump(local[ids > 0]), _dump(ids[ids > 0])))
        return _table(NUMBERS, rows)

    return requests.groupBy("lang", "shard").applyInArrow(run, NUMBERS)


class _Level:
    """How phrases of one size are packed and dealt out."""

    def __init__(self, gram_bits: int, word_bits: int, shards: int):
        self.word_bits, self.bits = word_bits, gram_bits + word_bits
        self.shard_bits = min(shards, self.bits - 1)
        self.order = quotient.Permutation(self.bits)

    def candidates(self, grams: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase may start whose two parts are frequent, and its permuted key."""
        at = np.flatnonzero((grams[:-1] > 0) & (grams[1:] > 0))
        return at, self.order((grams[at] << _U(self.word_bits)) | last[at + 1])

    def requests(self, chunk: int, lang: str, grams: np.ndarray, last: np.ndarray) -> list[tuple]:
        """The chunk's counts as a filter for each shard."""
        values, counts = np.unique(self.candidates(grams, last)[1], return_counts=True)
        rest = self.bits - self.shard_bits
        shard = (values >> _U(rest)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        low = values & _U((1 << rest) - 1)
        return [(1, chunk, lang, None, None, int(shard[i]), quotient.build(low[i:j], counts[i:j], rest))
                for i, j in zip(cut, [*cut[1:], len(values)])]


def _stream_rows(chunk: int, lang: str, grams: np.ndarray, last: np.ndarray, level: _Level | None) -> pa.Table:
    """A chunk for the next round: places of frequent phrases, one zero for each gap, and its requests."""
    keep = (grams > 0) | np.append(False, grams[:-1] > 0)
    grams, last = grams[keep], last[keep]
    rows = []
    if level is not None and len(grams) > 1:
        own = level.requests(chunk, lang, grams, last)
        if own:
            rows = [(0, chunk, lang, _dump(grams), None if (grams == last).all() else _dump(last), None, None), *own]
    return _table(STREAM, rows)


def _numbered(chunks: DataFrame, numbers: DataFrame, level: _Level) -> DataFrame:
    """Streams of vocabulary numbers (0: rare words and breaks) and requests for two words."""
    def run(stream: pa.Table, own: pa.Table) -> pa.Table:
        if not stream.num_rows or not own.num_rows:
            return _table(STREAM, [])
        local = _load(stream["tokens"][0].as_py()).astype(np.int64)
        number = np.zeros(int(local.max(initial=0)) + 1, _U)
        for place, ids in zip(own["locals"], own["ids"]):
            number[_load(place.as_py()).astype(np.int64)] = _load(ids.as_py())
        grams = number[local]
        return _stream_rows(stream["chunk"][0].as_py(), stream["lang"][0].as_py(), grams, grams, level)

    return chunks.groupBy("chunk").cogroup(numbers.groupBy("of")).applyInArrow(run, STREAM)


def _answered(streams: DataFrame, answers: DataFrame, level: _Level, following: _Level) -> DataFrame:
    """Streams of the phrases of this size that stayed, and requests for one word more."""
    def run(stream: pa.Table, own: pa.Table) -> pa.Table:
        if not stream.num_rows:
            return _table(STREAM, [])
        grams = _load(stream["grams"][0].as_py())
        last = stream["last"][0].as_py()
        last = grams if last is None else _load(last)
        at, value = level.candidates(grams, last)
        distinct, inverse = np.unique(value, return_inverse=True)
        number = np.zeros(len(distinct), _U)
        shard = (distinct >> _U(level.bits - level.shard_bits)).astype(np.int64)
        for s, answer in zip(own["shard"].to_pylist(), own["answer"]):
            i, j = np.searchsorted(shard, [s, s + 1])
            data = answer.as_py()
            here = np.unpackbits(np.frombuffer(data, np.uint8, -(-int(j - i) // 8)), count=int(j - i)).view(bool)
            number[i:j][here] = _load(data[-(-int(j - i) // 8):])
        new, new_last = np.zeros(len(grams), _U), np.zeros(len(grams), _U)
        new[at] = number[inverse]
        new_last[at] = last[at + 1]
        return _stream_rows(stream["chunk"][0].as_py(), stream["lang"][0].as_py(), new, new_last, following)

    return streams.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, STREAM)


def _counted(requests: DataFrame, level: _Level, min_count: int) -> DataFrame:
    """Kind 0: the frequent phrases of a shard; kind 1: which phrases of a chunk they are, and their numbers."""
    shards, rest = 1 << level.shard_bits, level.bits - level.shard_bits

    def run(table: pa.Table) -> pa.Table:
        lang, shard = table["lang"][0].as_py(), table["shard"][0].as_py()
        lists = [quotient.read(f.as_py()) for f in table["filter"]]
        values, counts = quotient.merge(lists)
        values, counts = values[counts >= min_count], counts[counts >= min_count]
        gram = np.arange(len(values)) * shards + shard + 1
        key = level.order.inverse(values | (_U(shard) << _U(rest) if rest < 64 else _U(0)))
        rows = [(0, None, lang, shard, None, g, k, n) for g, k, n in zip(gram.tolist(), key.tolist(), counts.tolist())]
        for chunk, (own, _) in zip(table["chunk"].to_pylist(), lists):
            at = np.searchsorted(values, own)
            here = at < len(values)
            here[here] = values[at[here]] == own[here]
            if here.any():
                rows.append((1, chunk, lang, shard, np.packbits(here).tobytes() + _dump(gram[at[here]].astype(_U)), None, None, None))
        return _table(ANSWER, rows)

    return requests.groupBy("lang", "shard").applyInArrow(run, ANSWER)


def _shard_bits(spark, items: int, shard_items: int) -> int:
    """Bits of the shard number, for shards of about ``shard_items`` occurrences, at least as many as there are shuffle partitions."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // shard_items))
    return (wanted - 1).bit_length()


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 5, min_count: int = 100,
                  chunk_bytes: int = CHUNK_BYTES, shard_items: int = SHARD_ITEMS) -> tuple[DataFrame, DataFrame] | None:
    """All phrases of 1 to ``max_words`` words that occur at least ``min_count`` times in a language: words (their numbers in it),
    size, lang, phrase, n, firsts (counts of its first 1, 2, ... words); and (lang, words) totals.  None where there are none."""
    spark = docs.sparkSession
    chunks = materialise(_chunks(docs, text_col, lang_col, chunk_bytes), "phrase-chunks", by="kind")
    totals = chunks.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    words = chunks.where("kind = 1")
    bits = _shard_bits(spark, words.agg(F.sum("n")).first()[0] or 0, shard_items)
    numbers = materialise(_word_numbers(_word_requests(words, bits), bits, min_count), "phrase-words", by="kind")
    release(chunks, part="kind=1")
    numbered = numbers.where("kind = 0").select("lang", "word", "id", "n")
    seen = numbered.agg(F.max("id").alias("id"), F.sum("n").alias("n")).first()
    if seen.id is None:
        return None
    word_bits = int(seen.id).bit_length()
    level = _Level(word_bits, word_bits, _shard_bits(spark, seen.n, shard_items))
    own = numbers.where("kind = 1").select(F.col("chunk").alias("of"), "locals", "ids")
    streams = materialise(_numbered(chunks.where("kind = 0").select("chunk", "lang", "tokens"), own, level), "phrase-streams", by="kind")
    totals = materialise(totals, "phrase-totals")
    release(chunks)
    found = [numbered.select(F.col("id").alias("gram"), F.array("id").alias("words"), "lang", F.col("word").alias("phrase"), "n", F.array("n").alias("firsts"))]
    for size in range(2, max_words + 1):
        counted = materialise(_counted(streams.where("kind = 1").select("lang", "shard", "chunk", "filter"), level, min_count), "phrase-answers", by="kind")
        release(streams, part="kind=1")
        kept = counted.where("kind = 0").select("lang", "gram", "key", "n")
        top = kept.agg(F.max("gram").alias("gram"), F.sum("n").alias("n")).first()
        if top.gram is None:
            release(streams)
            break
        base = F.lit(1 << level.word_bits).cast("decimal(20,0)")
        pairs = kept.select("lang", "gram", F.expr(f"key div {1 << level.word_bits}").cast("long").alias("before"), (F.col("key") % base).cast("long").alias("id"), "n")
        shorter = found[-1].select(F.col("gram").alias("before"), "words", "lang", "phrase", "firsts")
        longer = pairs.join(shorter, ["lang", "before"]).join(numbered.select("lang", "id", "word"), ["lang", "id"]).select(
            "gram", F.concat("words", F.array("id")).alias("words"), "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n",
            F.concat("firsts", F.array("n")).alias("firsts"))
        found.append(materialise(longer, "phrases"))
        if size < max_words:
            following = _Level(int(top.gram).bit_length(), word_bits, _shard_bits(spark, top.n, shard_items))
            nxt = materialise(_answered(streams.where("kind = 0").select("chunk", "lang", "grams", "last"),
                                        counted.where("kind = 1").select(F.col("chunk").alias("of"), "shard", "answer"), level, following), "phrase-streams", by="kind")
            level = following
        release(streams, counted)
        streams = nxt if size < max_words else None
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return materialise(out.drop("gram").withColumn("size", F.size("words")), "phrase-counts"), totals


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 5, min_count: int = 100,
                 scale: int = 1000, cover: int = 100, top: int = 2000, **sizes) -> DataFrame:
    """The ``top`` phrases of each language by score: ``scale * a * n / (l * r)`` of the lowest-scoring cut, without
    those inside a longer phrase that has at least ``cover`` percent of their occurrences."""
    spark = docs.sparkSession
    counted = phrase_counts(docs, text_col, lang_col, max_words, min_count, **sizes)
    if counted is None:
        return spark.createDataFrame([], RESULT)
    phrases, totals = counted
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    long = phrases.where("size > 1")
    cuts = long.select("words", "lang", "phrase", "n", "firsts", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("words", "lang", "phrase", F.col("n").alias("a"), "k", F.get("firsts", F.col("k") - 1).alias("l"),
                       F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    cuts = cuts.withColumn("under", wide("l") * wide("r"))
    score = F.expr(f"((cast({scale} * a as decimal(18,0)) * cast(total as decimal(18,0))) div under)")
    best = cuts.withColumn("score", score).groupBy("words", "lang", "phrase", "a", F.col("total").alias("n")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where("size > 2").select("lang", "size", "words", F.col("n").alias("whole")).select(
        "lang", "whole", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "whole", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", F.slice("words", F.col("at"), F.col("m")).alias("words"), "whole").groupBy("lang", "words").agg(F.max("whole").alias("whole"))
    left = best.join(inner, ["lang", "words"], "left").where(F.coalesce(100 * F.col("whole") < cover * F.col("a"), F.lit(True)))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


MAX_WORDS, MIN_COUNT, SCALE, COVER, TOP = 5, 100, 1000, 100, 2000


def op12_quotient_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_words=MAX_WORDS, min_count=MIN_COUNT,
                        scale=SCALE, cover=COVER, top=TOP)


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, {MAX_WORDS + 1}) s(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS c FROM o GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT lang, phrase, m, c AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
cut AS (SELECT k.lang, k.phrase, a, n, k, x.c AS l, y.c AS r, CAST((CAST({SCALE} AS HUGEINT) * a * n) // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
    FROM k JOIN t USING (lang) JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ')
    JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, c, w, m, s, unnest(range(1, m - s + 2)) AS i FROM
    (SELECT lang, c, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS s FROM f WHERE m > 2)),
inner_of AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(c) AS whole FROM sub GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inner_of USING (lang, phrase) WHERE whole IS NULL OR 100 * whole < {COVER} * a
QUALIFY rank <= {TOP}
"""
