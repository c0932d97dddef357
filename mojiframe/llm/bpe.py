"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regular expressions: every code point gets a class
from a lookup array; the pattern's alternatives become a transition table of
eight states; the transition functions of the characters are composed in
blocks and scanned (composition is associative), which gives the state at
every character and with it the token starts.  The slices between starts are
looked up in the ranks, then in a bounded cache, and the rest are merged
together, always the lowest-ranked leftmost pair of each slice first.

The pattern is ``public_tokenizers.PATTERN``: contractions, `` ?letters``,
`` ?numbers``, `` ?others``, white space up to the last before a word, white space.

Defined results: null and empty text have no ids; repeated rows give a row
each.  Every byte is a rank, so every text has an encoding, and decoding the ids
gives its UTF-8 bytes back.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from mojiframe.llm.common import map_text, named_again, text_rows

CACHE_PIECES = 50_000
LONG_PIECE = 64      # longer slices are merged with a heap
SCAN_BLOCK = 256
ENCODE_SLICE = 1 << 19

# classes of characters
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_RUN, PREFIX_SPACE, LAST_SPACE = range(8)
# what the character before belongs to
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_PREFIX, ONE_LEFT, TWO_LEFT, CLOSED = range(8)

#: White space of the pattern's ``\s`` (fixed values: the Unicode property White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether the character starts a token, by class and state."""
    nxt, start = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for run, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        nxt[run] = state
        start[run, [state, AFTER_PREFIX]] = False
    for quote, left in ((QUOTE2, ONE_LEFT), (QUOTE3, TWO_LEFT)):
        nxt[quote] = left
        nxt[quote, [IN_OTHERS, AFTER_PREFIX]] = IN_OTHERS  # inside a run of others it is one of them
        start[quote, [IN_OTHERS, AFTER_PREFIX]] = False
    nxt[SPACE_RUN] = IN_SPACES
    start[SPACE_RUN, IN_SPACES] = False
    nxt[PREFIX_SPACE], nxt[LAST_SPACE] = AFTER_PREFIX, CLOSED
    nxt[:, TWO_LEFT], nxt[:, ONE_LEFT] = ONE_LEFT, CLOSED
    start[:, [TWO_LEFT, ONE_LEFT]] = False
    return nxt, start


NEXT, START = _transitions()
#: A second set of classes: the first character of a text, whatever came before.
NEXT = np.concatenate([NEXT, np.repeat(NEXT[:, CLOSED:], 8, 1)]).ravel()
START = np.concatenate([START, np.ones((8, 8), bool)]).ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[WHITE] = SPACE_RUN
    return table


def character_classes(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Classes with what the pattern looks ahead for folded in; +8 at the start of a text."""
    c = _classes()[cp]
    n = len(cp)
    ends = np.zeros(n + 2, bool)  # no text goes on at these positions
    ends[offsets] = True
    ends[n:] = True
    after = np.append(cp, [0, 0])
    one, two = after[1:n + 1].copy(), after[2:n + 2].copy()
    one[ends[1:n + 1]] = 0
    two[ends[1:n + 1] | ends[2:n + 2]] = 0
    white = c == SPACE_RUN
    last = white & ~np.append(white[1:], False) & ~ends[1:n + 1]
    c[last & (cp == 0x20)] = PREFIX_SPACE
    c[last & (cp != 0x20)] = LAST_SPACE
    q = np.flatnonzero(cp == ord("'"))
    a, b = one[q], two[q]
    c[q[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE2
    c[q[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = QUOTE3
    c[offsets[:-1][offsets[:-1] < offsets[1:]]] += 8
    return c


def token_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which characters start a token; texts lie between the offsets."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // SCAN_BLOCK)
    c = np.zeros(blocks * SCAN_BLOCK, np.int16)
    c[:n] = character_classes(cp, offsets)
    c = np.ascontiguousarray(c.reshape(blocks, SCAN_BLOCK).T) * 8
    # the function of each block: its end state from each entry state
    fn = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for t in range(SCAN_BLOCK):
        fn = NEXT[c[t][:, None] + fn]
    # inclusive scan by doubling: fn[k] becomes the function of blocks 0..k
    d = 1
    while d < blocks:
        fn[d:] = np.take_along_axis(fn[d:], fn[:-d].astype(np.int64), 1)
        d *= 2
    state = np.full(blocks, CLOSED, np.uint8)
    state[1:] = fn[:-1, CLOSED]
    out = np.zeros((SCAN_BLOCK, blocks), bool)
    for t in range(SCAN_BLOCK):
        at = c[t] + state
        out[t] = START[at]
        state = NEXT[at]
    return out.T.ravel()[:n]


class Bpe:
    """Ranks, pair table and piece cache of one worker."""

    def __init__(self, lines: list[bytes]):
        self.tokens: dict[bytes, int] = {}
        for line in lines:
            if line.strip():
                token, rank = line.split()
                self.tokens[base64.b64decode(token)] = int(rank)
        if sorted(self.tokens.values()) != list(range(len(self.tokens))):
            raise ValueError("ranks must be 0, 1, 2, ... without gaps")
        self.bytes = [b""] * len(self.tokens)
        for token, rank in self.tokens.items():
            self.bytes[rank] = token
        self.byte_ids = np.array([self.tokens[bytes([i])] for i in range(256)], np.int64)
        self.whole = {t: np.int32(r).tobytes() for t, r in self.tokens.items()}
        get = self.tokens.get
        pairs = {(a << 32) | b: r for t, r in self.tokens.items() for i in range(1, len(t))
                 if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None}
        self.pairs = pd.Index(np.fromiter(pairs, np.int64, len(pairs)))
        self.ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs)), len(self.tokens))
        self.none = len(self.tokens)
        self.cache: dict[bytes, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks[self.pairs.get_indexer((a << 32) | b)]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian int32) of slices of at most LONG_PIECE bytes, merged in rounds."""
        out = [b""] * len(pieces)
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(sym), self.none)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            done = low == self.none
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[own[first[k]]] = sym[first[k]:first[k] + size[k]].astype(np.int32).tobytes()
                live = np.repeat(~done, size)
                sym, own, rank = sym[live], own[live], rank[live]
                if not len(sym):
                    break
                low, size = low[~done], size[~done]
                first = np.append(0, np.cumsum(size)[:-1])
            hits = np.flatnonzero(rank == np.repeat(low, size))
            at = hits[np.append(True, own[hits][1:] != own[hits][:-1])]  # the leftmost of each slice
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            sym, own, rank = sym[keep], own[keep], rank[keep]
            right = new[new + 1 < len(sym)]
            right = right[own[right] == own[right + 1]]
            rank[new] = self.none
            rank[right] = self.pair_ranks(sym[right], sym[right + 1])
            left = new[new > 0] - 1
            left = left[own[left] == own[left + 1]]
            rank[left] = self.pair_ranks(sym[left], sym[left + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one slice of any length, in n log n steps."""
        sym = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, rank_of = len(sym), dict(zip(self.pairs.tolist(), self.ranks.tolist()))
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank_of.get((sym[i] << 32) | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (q := rank_of.get((r << 32) | sym[k])) is not None:
                    heapq.heappush(heap, (q, i, r, sym[k]))
            if (h := prv[i]) >= 0 and (q := rank_of.get((sym[h] << 32) | r)) is not None:
                heapq.heappush(heap, (q, h, sym[h], r))
        return np.array([x for x in sym if x >= 0], np.int32).tobytes()

    def pieces(self, unique: list[bytes]) -> list[bytes]:
        """Ids of each slice, from the ranks, the cache or by merging."""
        get, cached = self.whole.get, self.cache.get
        out = [get(p) or cached(p) for p in unique]
        todo = [i for i, x in enumerate(out) if x is None]
        if todo:
            short = [i for i in todo if len(unique[i]) <= LONG_PIECE]
            if len(self.cache) + len(short) > CACHE_PIECES:
                self.cache.clear()
            for i, x in zip(short, self.merge_many([unique[i] for i in short])):
                out[i] = x
                if len(self.cache) < CACHE_PIECES:
                    self.cache[unique[i]] = x
            for i in todo:
                if out[i] is None:
                    out[i] = self.merge_long(unique[i])
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and n+1 offsets by text; byte starts of pieces (within the text), the
        index of the first id of each (within the text), and n+1 offsets of pieces."""
        texts = [t or "" for t in texts]
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        at = np.flatnonzero(token_starts(cp, offsets))
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.append(0, np.cumsum(width))
        starts = byte[at]
        bounds = np.append(starts, len(raw)).astype(np.int64)  # pieces lie side by side
        kinds = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        inverse = kinds.indices.to_numpy().astype(np.int64)
        got = self.pieces(kinds.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(got), np.int32)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        base = np.append(0, np.cumsum(size))[:-1]
        n_ids = size[inverse]
        ptr = np.append(0, np.cumsum(n_ids))
        ids = flat[np.repeat(base[inverse] - ptr[:-1], n_ids) + np.arange(ptr[-1])] if len(inverse) else flat
        cut = np.searchsorted(at, offsets, "left")
        own = np.repeat(np.arange(len(texts)), np.diff(cut))
        return ids, ptr[cut], starts - byte[offsets[:-1]][own], ptr[:-1] - ptr[cut[:-1]][own], cut

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> Bpe:
    """The tokenizer of a rank file; the file lies with the Python packages of every executor."""
    with open(path, "rb") as f:
        return Bpe(f.read().splitlines())


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _list(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
           keep: tuple[str, ...] = (), round_trip: bool = False) -> DataFrame:
    """One row per document: id, ids, piece_starts (byte offset of each piece),
    piece_ids (index of its first id) and the columns ``keep``; with ``round_trip``
    instead of the pieces ``decoded``, the bytes that the ids decode to, in the same pass."""
    path = ranks or default_ranks()
    new = "ids array<int>, decoded binary" if round_trip else "ids array<int>, piece_starts array<int>, piece_ids array<int>"

    def make():
        bpe = load(path)

        def run(b: pa.RecordBatch) -> list[pa.Array]:
            ids, ptr, starts, firsts, cut = bpe.encode(b.column(1).to_pylist())
            if round_trip:
                flat, at = ids.tolist(), ptr.tolist()
                return [_list(ids, ptr), pa.array([bpe.decode(flat[s:e]) for s, e in zip(at, at[1:])], pa.binary())]
            return [_list(ids, ptr), _list(starts, cut), _list(firsts, cut)]

        return run

    found = map_text(text_rows(docs, id_col, text_col, keep), make, new, ENCODE_SLICE)
    return named_again(found, id_col, keep, *[c.split()[0] for c in new.split(", ")])


def decode(encoded: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids; null ids decode to null."""
    path = ranks or default_ranks()
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches):
        bpe = load(path)
        for big in batches:
            for k in range(0, big.num_rows, 1000):
                b = big.slice(k, 1000)
                col = b.column(b.schema.get_field_index(ids_col))
                flat, ptr = col.flatten().to_pylist(), np.append(0, np.cumsum(col.value_lengths().fill_null(0).to_numpy())).tolist()
                out = [bpe.decode(flat[s:e]) if ok else None for s, e, ok in zip(ptr, ptr[1:], col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(done: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with ids and decoded: id, the columns ``keep``, n_tokens, ids_sha256
    (decimal ids joined by a space) and decoded_sha256."""
    return done.select(id_col, *keep, F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), round_trip=True), "doc_id")
