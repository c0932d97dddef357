"""N-gram language model over the whole corpus: quantised smoothed
probabilities in Elias-Fano tries, and the log10 probability of every text.

The model (order k, tokens ``w``, context ``x`` of k - 1 tokens, ``x'`` without
its first):

    p1(w)   = (c(w) + 1) / (N + V + 1)
    pk(w|x) = (c(xw) + m(x) * q(p(k-1)(w|x'))) / (c(x) + m(x))    if c(x) >= min_context
            = p(k-1)(w|x')                                        otherwise
    m(x)    = mu * c(x) ** POWER

m(x) stands for the number of kinds of words after x, which grows nearly as its count.
``c`` counts over all training texts; q rounds log10 p to 1/4096.  A text starts
in a context of its own (its first token has no longer one).  The score is the
sum of the rounded log10 p of all tokens and the end.

How it runs.  Texts become chunks of a few MB (one row each: token stream, word
hashes).  For every order a chunk sends its *distinct* n-grams with their training
counts to shards by the hash of the n-gram, so a frequent n-gram is one entry a
chunk and never gathers in one place.  An n-gram goes as two numbers, those of its context and of
the n-gram without its first word: the levels below tell the rest.  A shard adds the counts up and writes its part of
the level once, as a file in the shared folder (``eliasfano.WordLevel``, ``eliasfano.TrieLevel``).
Chunks map the files of the orders done and look their n-grams up there, by
successor search relative to the context; the number of an n-gram found is the context of the next
order.  Nothing else is kept of an order: no answer is shuffled.  The counts of an order lie in the shared folder
in ``TURNS`` parts, each of some shards; a part is shuffled, learned from and deleted before the next, so the counts
go as the level comes.  Shards number one for every ``SHARD_BYTES`` of packed chunks, so their size stays as the input grows.
A chunk looks into every shard of each order, so its text is large, words have fewer shards, and files stay mapped
from one chunk to the next; counts of contexts come with the n-grams, not from the files.

A level's file has its order and shard for a name and the same bytes whichever task writes it; it appears
under that name when it is whole, so a task that runs twice does no harm.

Word hashes have 64 bits; two different words among k meet with a chance of
about k*k / 2**65.

Defined results: null and empty texts have one token, the end; rows whose
``train`` is null are not learned from; repeated rows count as often as they
come; without training rows every score is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiframe.llm.common import crc_mod, delete, materialise, release, scratch_path, slices, text_buffer
from mojiframe.llm.eliasfano import EliasFano, TrieLevel, WordLevel
from mojiframe.llm.words import SPACE_WORDS, mix, split

ORDER = 3
MU = 2.0
POWER = 0.9
MIN_CONTEXT = 1  # every context that was seen
STEP = 1 / 4096
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20  # packed chunks that a shard counts for
TURNS = 8  # parts of an order's counts
WORD_SHARE = 16  # shards of n-grams for one of words, which are fewer
OPEN_LEVELS = 4096  # files that a task holds mapped: some kilobytes each, and a chunk goes through all of them
MISSING = 0xFFFF

_U = np.uint64
END = _U(0x0E4D0E4D0E4D0E4D)  # the hash of the end
START, FIRST = 1, 2           # numbers: 0 unknown, 1 the start of a text, then the words


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    head = [np.int64(len(arrays)).tobytes()]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(a.dtype.str.encode().ljust(8) + np.int64(len(a)).tobytes())
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * count, []
    for k in range(count):
        kind = np.dtype(raw[8 + 16 * k:16 + 16 * k].decode().strip())
        n = int(np.frombuffer(raw, np.int64, 1, 16 + 16 * k)[0])
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) / STEP), MISSING - 1).astype(np.uint16)


_POWERS = 10.0 ** (np.arange(1 << 16) * -STEP)


def unquantise(code: np.ndarray) -> np.ndarray:
    return _POWERS[code]


def backing(total: np.ndarray, mu: float) -> np.ndarray:
    """The weight of the shorter context."""
    return mu * total ** POWER


def smoothed(count: np.ndarray, lower: np.ndarray, total: np.ndarray, mu: float) -> np.ndarray:
    """Codes of n-grams from their counts, the codes without the first word and the counts of their contexts."""
    total = total.astype(np.float64)
    spread = backing(total, mu)
    return quantise((count + spread * unquantise(lower)) / (total + spread))


def make_chunks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """A row a chunk: ids, stream (token counts, training flags and each token's place in
    the word list) and words (hashes and training counts)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for big in batches:
            for b in slices(big, "text", CHUNK_BYTES):
                w = split(*text_buffer(b.column(1)), SPACE_WORDS)
                rows = b.num_rows
                h = np.empty(len(w.starts) + rows, _U)
                first = w.first + np.arange(rows + 1)
                ends = first[1:] - 1
                inner = np.ones(len(h), bool)
                inner[ends] = False
                h[inner], h[ends] = w.hashes(), END
                learn = b.column(2).fill_null(False).to_numpy(False)
                inverse, seen = pd.factorize(h)
                count = np.bincount(inverse, minlength=len(seen))
                by = np.argsort(-count, kind="stable")  # frequent words get small places
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by))
                trained = np.bincount(inverse, weights=np.repeat(learn, np.diff(first)), minlength=len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk]), pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)),
                    pa.array([pack(_small(np.diff(first)), learn.astype(np.uint8), _small(place[inverse]))], pa.binary()),
                    pa.array([pack(seen[by], _small(trained[by]))], pa.binary())], names=["chunk", "ids", "stream", "words"])
                chunk += 1

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), train.alias("train"))
    return d.mapInArrow(run, f"chunk long, ids array<{kind}>, stream binary, words binary")


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h ^ _U(0x1D8E4E27C47D124F)) % _U(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that occur, each with its rows."""
    by = np.argsort(_small(shard), kind="stable")
    cut = np.flatnonzero(np.append(True, shard[by][1:] != shard[by][:-1])) if len(by) else by
    for rows in np.split(by, cut[1:]) if len(by) else []:
        yield int(shard[rows[0]]), rows


def _requests(shard: np.ndarray, arrays: Callable[[np.ndarray], tuple]) -> pa.RecordBatch:
    """Rows (shard, data): ``arrays(rows)`` for the rows of each shard, in order."""
    rows = [(s, pack(*arrays(r))) for s, r in _by_shard(shard)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                      names=["shard", "data"])


class Levels:
    """The files of the model in the shared folder, mapped as they are asked for."""

    def __init__(self, root: str, shards: int, min_context: int):
        self.root, self.shards, self.min_context = root, shards, min_context
        self.word_shards = max(1, shards // WORD_SHARE)
        self.opened = lru_cache(OPEN_LEVELS)(self._open)

    def __reduce__(self):
        return Levels, (self.root, self.shards, self.min_context)  # every task maps its own

    def of(self, order: int) -> int:
        """How many shards an order has."""
        return self.word_shards if order == 1 else self.shards

    def _place(self) -> tuple[pafs.FileSystem, str]:
        root = self.root.replace("file:", "file://", 1) if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root
        return pafs.FileSystem.from_uri(root)

    def write(self, order: int, shard: int, data: bytes) -> None:
        fs, folder = self._place()
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/.{order}-{shard}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(data)
        fs.move(own, f"{folder}/{order}-{shard}")

    def _open(self, order: int, shard: int) -> WordLevel | TrieLevel | None:
        """A level, or None for a shard that has no n-grams of this order."""
        fs, folder = self._place()
        path = f"{folder}/{order}-{shard}"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        return (WordLevel if order == 1 else TrieLevel).open(source.read_buffer())

    def find(self, order: int, shard: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (0: unknown), counts (0: unknown, or too rare to be a context), codes (``MISSING``: none)."""
        number, count, code = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64), np.full(len(shard), MISSING, np.uint16)
        for s, rows in _by_shard(shard):
            level = self.opened(order, s)
            if level is None:
                continue
            at = level.find(*[k[rows] for k in keys])
            rows, at = rows[at >= 0], at[at >= 0]
            if order > 1:
                code[rows] = level.codes[at]
            if len(level.counts):
                c = level.counts[at].astype(np.int64)
                count[rows] = np.where(c >= (self.min_context if order > 1 else 1), c, 0)
                number[rows] = at * self.of(order) + s + FIRST
        return number, count, code

    def counts(self, order: int, number: np.ndarray) -> np.ndarray:
        """Counts of the n-grams of these numbers; as many texts start as end."""
        out = np.zeros(len(number), np.int64)
        start = number == START
        if start.any():
            end = np.array([END])
            out[start] = self.find(1, _shard(end, self.word_shards), end)[1]
        inner = np.flatnonzero(~start)
        at, shard = np.divmod(number[inner] - FIRST, self.of(order))
        for s, rows in _by_shard(shard):
            out[inner[rows]] = self.opened(order, s).counts[at[rows]]
        return out

    def grams(self, order: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, words and codes of the n-grams of these numbers, from the second order on."""
        context, word, code = np.empty(len(number), np.int64), np.empty(len(number), np.int64), np.empty(len(number), np.uint16)
        at, shard = np.divmod(number - FIRST, self.shards)
        for s, rows in _by_shard(shard):
            level, rows = self.opened(order, s), rows[np.argsort(at[rows])]
            context[rows], word[rows] = level.grams(at[rows])
            code[rows] = level.codes[at[rows]]
        return context, word, code


def count_words(chunks: DataFrame, levels: Levels) -> DataFrame:
    """The first level; a row a shard with its tokens and its words."""

    def ask(batches):
        for b in batches:
            for words in b.column(0):
                h, count = unpack(words.as_py())
                known = np.flatnonzero(count)
                h, count = h[known], count[known]
                yield _requests(_shard(h, levels.word_shards), lambda r: (h[r], count[r]))

    def learn(t: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in t.column("data")]
        inverse, h = pd.factorize(np.concatenate([g[0] for g in got]))
        count = np.bincount(inverse, weights=np.concatenate([g[1] for g in got])).astype(np.int64)
        by = np.argsort(h)
        levels.write(1, t.column("shard")[0].as_py(), WordLevel(EliasFano.build(h[by]), _small(count[by])).to_bytes())
        return pa.table({"tokens": pa.array([count.sum()], pa.int64()), "types": pa.array([len(h)], pa.int64())})

    asked = chunks.select("words").mapInArrow(ask, "shard long, data binary")
    return asked.groupBy("shard").applyInArrow(learn, "tokens long, types long")


class Chunk:
    """What a chunk knows of its tokens, order by order."""

    def __init__(self, stream: bytes, words: bytes, stats: tuple[int, int], mu: float, levels: Levels):
        size, self.learn, place = unpack(stream)
        self.size, self.place = size.astype(np.int64), place.astype(np.int64)
        self.first = np.append(0, np.cumsum(self.size))
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.mu, self.levels = mu, levels
        h = unpack(words)[0]
        number, count, _ = levels.find(1, _shard(h, levels.word_shards), h)
        self.n_words = len(number)
        self.word, self.base_count = number[self.place], count[self.place]
        p = (count + 1) / (stats[0] + stats[1] + 1)
        self.base, self.code = np.log10(p)[self.place], quantise(p)[self.place]
        self.number, self.count = self.word, self.base_count  # of the n-gram that ends here
        self.starts = int(self.base_count[self.first[1] - 1])  # as many starts as ends
        self.order = 1

    def ask(self) -> None:
        """The distinct n-grams of the next order, by context."""
        k = self.order + 1
        n = len(self.place)
        self.context, self.context_count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.context[1:], self.context_count[1:] = self.number[:-1], self.count[:-1]
        opening = self.first[:-1]
        self.context[opening], self.context_count[opening] = (START, self.starts) if k == 2 else (0, 0)
        self.live = (self.context > 0) & (self.context_count >= self.levels.min_context)
        pos = np.flatnonzero(self.live & (self.word > 0))
        key = self.context[pos] * self.n_words + self.place[pos]
        order = np.argsort(key)
        key, self.pos = key[order], pos[order]
        new = np.append(True, key[1:] != key[:-1])[:len(key)]
        cut = np.flatnonzero(new)
        self.inverse, self.gram_at = np.cumsum(new) - 1, self.pos[cut]
        learn = self.learn[self.doc[self.pos]]
        self.trained = np.add.reduceat(learn, cut, dtype=np.int64) if len(cut) else np.zeros(0, np.int64)
        g = self.gram_at
        self.shard = _shard(self.context[g].astype(_U) * _U(0x9E3779B97F4A7C15) + self.word[g].astype(_U), self.levels.shards)

    def requests(self) -> pa.RecordBatch:
        """By shard, of what is learned from: steps between context numbers, run lengths; numbers of the n-grams
        without their first words, training counts; counts of the contexts."""
        known = np.flatnonzero(self.trained)
        g, trained = self.gram_at[known], self.trained[known]

        def arrays(r):
            x = g[r]
            run = np.flatnonzero(np.append(True, self.context[x][1:] != self.context[x][:-1]))
            return (_small(np.diff(self.context[x[run]], prepend=0)), _small(np.diff(np.append(run, len(x)))),
                    _small(self.number[x]), _small(trained[r]), _small(self.context_count[x[run]]))

        return _requests(self.shard[known], arrays)

    def take(self, last: bool = False) -> None:
        """The probabilities, numbers and counts of the order asked for, from its level.  At the last order an n-gram
        that comes here as often as its context does anywhere needs no search: its count is that of the context."""
        g = self.gram_at
        number, count = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        code = np.full(len(g), MISSING, np.uint16)
        sure = (self.trained == self.context_count[g]) if last else np.zeros(len(g), bool)
        total = self.context_count[g[sure]]
        code[sure] = smoothed(total, self.code[g[sure]], total, self.mu)
        rest = np.flatnonzero(~sure)
        x = g[rest]
        number[rest], count[rest], code[rest] = self.levels.find(self.order + 1, self.shard[rest], self.context[x], self.word[x])
        got = code[self.inverse]
        known = got != MISSING
        new, unseen = self.code.copy(), self.live.copy()
        new[self.pos[known]] = got[known]
        unseen[self.pos[known]] = False
        unseen = np.flatnonzero(unseen)
        new[unseen] = smoothed(np.zeros(len(unseen)), self.code[unseen], self.context_count[unseen], self.mu)
        self.number, self.count = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64)
        self.number[self.pos], self.count[self.pos] = number[self.inverse], count[self.inverse]
        self.code, self.order = new, self.order + 1

    def up_to(self, order: int, last: bool = False) -> None:
        while self.order < order:
            self.ask()
            self.take(last and self.order + 1 == order)


def count_grams(chunks: DataFrame, order: int, stats: tuple[int, int], mu: float, levels: Levels) -> DataFrame:
    """The counts of an order; rows of a turn, a shard and what a chunk has for it."""

    def ask(batches):
        for b in batches:
            for stream, words in zip(b.column(0), b.column(1)):
                c = Chunk(stream.as_py(), words.as_py(), stats, mu, levels)
                c.up_to(order - 1)
                c.ask()
                yield c.requests()

    asked = chunks.select("stream", "words").mapInArrow(ask, "shard long, data binary")
    return asked.withColumn("turn", (F.col("shard") % TURNS).cast("int"))


def learn_grams(asked: DataFrame, order: int, stats: tuple[int, int], mu: float, levels: Levels, last: bool) -> DataFrame:
    """The level of an order for the shards of a turn; a row a shard with its n-grams."""

    def learn(t: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in t.column("data")]
        cat = lambda k: np.concatenate([g[k] for g in got])  # noqa: E731  in the widest type they need
        contexts = np.concatenate([np.cumsum(g[0], dtype=np.int64) for g in got])
        context, suffix, total = np.repeat(contexts, cat(1)), cat(2).astype(np.int64), np.repeat(cat(4), cat(1))
        by = np.argsort(np.repeat(pd.factorize(contexts)[0], cat(1)) * (int(suffix.max()) + 1) + suffix)
        context, suffix = context[by], suffix[by]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (suffix[1:] != suffix[:-1])))
        count = np.add.reduceat(cat(3)[by], first, dtype=np.int64)
        context, suffix, total = context[first], suffix[first], total[by[first]]
        if order == 2:
            short, word, lower = np.zeros(len(suffix), np.int64), suffix, quantise((levels.counts(1, suffix) + 1) / (stats[0] + stats[1] + 1))
        else:
            short, word, lower = levels.grams(order - 1, suffix)
        codes = smoothed(count, lower, total, mu)
        level, _ = TrieLevel.build(context, short, word, codes, None if last else count)
        levels.write(order, t.column("shard")[0].as_py(), level.to_bytes())
        return pa.table({"grams": pa.array([len(first)], pa.int64())})

    return asked.select("shard", "data").groupBy("shard").applyInArrow(learn, "grams long")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                mu: float = MU, min_context: int = MIN_CONTEXT) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score (unigrams
    with add-one smoothing) and score, learned from the rows where ``train`` holds."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    root = scratch_path(spark, "ngram-levels")
    made = [materialise(make_chunks(docs, id_col, text_col, train).repartition("chunk"), "chunks")]
    chunks = made[0]
    size = chunks.agg(F.sum(F.octet_length("stream") + F.octet_length("words"))).first()[0] or 0
    levels = Levels(root, max(1, -(-size // SHARD_BYTES)), min_context)
    made.append(materialise(count_words(chunks, levels), "words"))
    stats = tuple(made[-1].agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    for k in range(2, order + 1):
        asked = materialise(count_grams(chunks, k, stats, mu, levels), f"counts-{k}", by="turn")
        for turn in range(min(TURNS, levels.shards)):
            made.append(materialise(learn_grams(asked.where(F.col("turn") == turn), k, stats, mu, levels, k == order), f"grams-{k}"))
            release(asked, part=f"turn={turn}")
        made.append(asked)

    def finish(batches):
        for b in batches:
            for ids, stream, words in zip(*b.columns):
                c = Chunk(stream.as_py(), words.as_py(), stats, mu, levels)
                c.up_to(order, last=True)
                add = lambda x: np.add.reduceat(x, c.first[:-1])  # noqa: E731  every text has a token
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(c.size), pa.array(add((c.base_count > 0).astype(np.int64))), pa.array(np.full(len(c.size), stats[0])),
                     pa.array(add(c.base)), pa.array(add(c.code * -STEP))],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = materialise(chunks.select("ids", "stream", "words").mapInArrow(
        finish, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    release(*made)
    delete(spark, root)
    return out.withColumnRenamed("id", id_col)


def op3_ngram_lm(spark, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    return scored.withColumn("held_out", held_out)
