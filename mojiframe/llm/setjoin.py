"""Exact Jaccard self-join on word shingles with set relations.

1. Every text becomes its set of shingle hashes; equal sets are one node (a
   64-bit fingerprint), so copies never multiply the work.
2. Prefix lists: two sets of similarity t share one of the first
   ``n - ceil(t n) + 1`` shingles of each in any common order.  The order here
   is: unknown shingles by hash, then the most frequent ones by frequency.
3. The lists are split by size band (a set joins its own and the next band)
   and into blocks by position.  A block whose remaining shingles cannot reach
   the overlap that a set needs is skipped for it, and a set left with no block
   leaves the list.
4. Set relations: the smallest node of a list is its leader r.  All lists of a
   leader are one group, so a (leader, member) pair is kept once, however
   many lists it shares.  Each member x carries only what it adds to r and what
   it lacks of r.  The overlap of two members follows from these differences:
   ``|x & z| = |r| - |r-x| - |r-z| + |(r-x) & (r-z)| + |(x-r) & (z-r)|``,
   so the answers of x are derived from those of r without reading x again.
   No candidate pairs are ever emitted as rows.
5. Before any set is fetched, the members of a group are compared by parity
   bitmaps (as many bits as the set has elements): the number of bits that differ is at most the number
   of elements that differ, so a pair beyond the bound is out.  Members that
   may have partners form smaller groups with leaders of their own.
6. Groups larger than ``BLOCK`` members are cut into pairs of blocks.  A group
   gives the smallest member of each of its components and link counts;
   the components are joined by alternating large-star and small-star rounds
   that read and write tables in the shared folder.

The frequency table (``HOT`` entries at most) only orders shingles: whatever it
holds, the result is the same.

Shingle and set hashes have 64 bits; two different ones among k meet with a
chance of about k*k / 2**65.

Defined results: null or empty text, or text without words, has size 0, links
with nothing and is its own component; fewer words than a shingle: the whole
sequence is one shingle; copies link with each other; rows that repeat an id
keep a row each; rows with null id take no part and have a null component.
Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiframe.llm import bitmap
from mojiframe.llm.common import SLICE_BYTES, materialise, release, slices, text_buffer, text_rows
from mojiframe.llm.words import SPACE_WORDS, mix, ngram_hashes, split

HOT = 1 << 18
BLOCK = 1024
DENSE_COLUMNS = 512
STRIPE = 128           # rows of a block's square matrices that are worked on at once
COUNT_SLICE = 4 << 20  # text bytes among which shingles must come twice to be counted

_U = np.uint64


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and offsets."""
    w = split(raw, offsets, SPACE_WORDS)
    h, rows = w.hashes(), len(offsets) - 1
    grams = ngram_hashes(h, n)
    inside = w.doc[:len(grams)] == w.doc[n - 1:] if len(grams) else np.zeros(0, bool)
    doc, val = w.doc[:len(grams)][inside], grams[inside]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence as one, told apart by its length
        whole = np.concatenate([ngram_hashes(h[w.first[i]:w.first[i + 1]], int(count[i])) for i in short.tolist()])
        whole = mix(whole + count[short].astype(_U) * _U(0xA24BAED4963EE407))
        doc, val = np.append(doc, short), np.append(val, whole)
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    keep = np.ones(len(val), bool)
    keep[1:] = (val[1:] != val[:-1]) | (doc[1:] != doc[:-1])
    doc, val = doc[keep], val[keep]
    return val, np.append(0, np.cumsum(np.bincount(doc, minlength=rows)))


class _Sets:
    """The sets of one slice of texts."""

    def __init__(self, b: pa.RecordBatch, n: int):
        self.val, self.ptr = shingle_sets(*text_buffer(b.column(1)), n)
        self.size = np.diff(self.ptr)
        total = np.append(_U(0), np.cumsum(mix(self.val ^ _U(0x5851F42D4C957F2D))))
        self.node = mix(total[self.ptr[1:]] - total[self.ptr[:-1]] + self.size.astype(_U)).view(np.int64)

    def keep(self, rows: np.ndarray) -> None:
        """Only these rows from now on."""
        self.val = self.val[np.repeat(rows, self.size)]
        self.size, self.node = self.size[rows], self.node[rows]
        self.ptr = np.append(0, np.cumsum(self.size))

    def fresh(self, seen: set[int], able: np.ndarray) -> None:
        """Drop copies that this task has had already (as far as ``seen`` goes)."""
        out = np.zeros(len(self.node), bool)
        for i, x in enumerate(self.node.tolist()):
            out[i] = able[i] and x not in seen
            if len(seen) < 1 << 20:
                seen.add(x)
        self.keep(out)


def parity_bitmaps(sets: _Sets) -> list[bytes]:
    """One bit flip an element, in the next power of two of bits (64 at least)."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sets.size, 1))).astype(np.int64))
    base = np.append(0, np.cumsum(bits))
    at = np.repeat(base[:-1], sets.size) + (sets.val % np.repeat(bits, sets.size).astype(_U)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=base[-1]).astype(np.uint8) & 1).tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def _each_slice(texts: DataFrame, n: int, fn, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``fn(sets, rows, seen)`` for each slice gives the columns of ``schema``; rows
    without words or id only come to it as rows, not as sets, where it asks so."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for b in slices(big, "text", limit):
                yield pa.RecordBatch.from_arrays(fn(_Sets(b, n), b, seen), names=names)

    return texts.mapInArrow(run, schema)


def _able(sets: _Sets, b: pa.RecordBatch) -> np.ndarray:
    return (sets.size > 0) & b.column(0).is_valid().to_numpy(False)


def set_rows(texts: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows: (id, n, node, flips) of every text, and (s, c) of the shingles
    that come more than once among the texts of a slice."""
    kind = texts.schema["id"].dataType.simpleString()

    def fn(sets: _Sets, b: pa.RecordBatch, seen: set[int]) -> list[pa.Array]:
        size, node, flips = sets.size, pa.array(sets.node, mask=sets.size == 0), pa.array(parity_bitmaps(sets), pa.binary())
        sets.fresh(seen, _able(sets, b))
        s, c = np.unique(sets.val, return_counts=True)
        s, c = s[c > 1], c[c > 1]
        more, rows = len(s), b.num_rows
        return [pa.concat_arrays([x, pa.nulls(more, x.type)]) for x in (b.column(0), pa.array(size), node, flips)] + [
            pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(x)]) for x in (s.view(np.int64), c)]

    return _each_slice(texts, n, fn, f"id {kind}, n long, node long, flips binary, s long, c long", COUNT_SLICE)


def frequent_shingles(counted: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``hot`` shingle hashes of highest count, sorted, with their counts.
    Only shingles that come twice in a slice are counted: it orders, it decides nothing."""
    counts = materialise(counted.groupBy("s").agg(F.sum("c").alias("c")), "shingle-counts")
    # the smallest count that keeps the table within its bound; the histogram has a row for each power of 2**(1/4)
    level = F.ceil(4 * F.log2("c")).cast("long")
    room, least = hot, None
    for lv, k in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True):
        if k > room:
            break
        room, least = room - k, lv
    rows = counts.where(level >= F.lit(least)).toArrow()
    release(counts)
    val, c = rows.column("s").to_numpy().view(_U), rows.column("c").to_numpy()
    order = np.argsort(val)
    return val[order], c[order]


def prefix_entries(texts: DataFrame, n: int, frequent: tuple[np.ndarray, np.ndarray], num: int, den: int) -> DataFrame:
    """s (shingle), node, n, pos: the prefix of every set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def fn(sets: _Sets, b: pa.RecordBatch, seen: set[int]) -> list[pa.Array]:
        hot, count = shared.value
        sets.fresh(seen, _able(sets, b))
        val, ptr, size = sets.val, sets.ptr, sets.size
        doc = np.repeat(np.arange(len(size)), size)
        rank = np.zeros(len(val), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, val), len(hot) - 1)
            rank = np.where(hot[at] == val, count[at], 0)
        order = np.lexsort((val, rank, doc))
        pos = np.arange(len(val)) - ptr[:-1][doc]
        keep = pos < (size - -(-size * num // den) + 1)[doc]
        doc, pos, val = doc[keep], pos[keep], val[order][keep]
        return [pa.array(val.view(np.int64)), pa.array(sets.node[doc]), pa.array(size[doc].astype(np.int32)), pa.array(pos.astype(np.int32))]

    return _each_slice(texts, n, fn, "s long, node long, n int, pos int")


def member_sets(texts: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """(node, n, shingles) of the given nodes.  A bitmap of fixed size thins the
    texts where they are read, an exact join decides."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.build(nodes, F.col("node")))

    def fn(sets: _Sets, b: pa.RecordBatch, seen: set[int]) -> list[pa.Array]:
        sets.fresh(seen, _able(sets, b) & bitmap.holds(shared.value, sets.node))
        data = np.ascontiguousarray(sets.val).view(np.uint8)
        packed = pa.Array.from_buffers(pa.binary(), len(sets.size), [None, pa.py_buffer((sets.ptr * 8).astype(np.int32)), pa.py_buffer(data)])
        return [pa.array(sets.node), pa.array(sets.size), packed]

    found = _each_slice(texts, n, fn, "node long, n long, shingles binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _unpack(b: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = text_buffer(b.column(b.schema.get_field_index(col)))
    return np.frombuffer(raw.tobytes(), _U), offs // 8


def leader_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(r, node): each node under the leaders of its lists, once."""
    shared = entries.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("s")
    e = entries.join(shared, "s")
    band = F.floor(F.log("n") / (F.log(F.lit(den / num)) * (1 + 1e-9))).cast("int")
    e = e.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    e = e.withColumn("block", F.floor(F.log2(F.col("pos") + 1)).cast("int")).withColumn("rest", F.col("n") - F.col("pos"))
    e = materialise(e, "list-entries")  # small: lists of two and more only
    blocks = e.groupBy("s", "band", "block").agg(
        F.max("rest").alias("rest"), F.min("n").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.max("own").alias("own"))
    lists = blocks.groupBy("s", "band").agg(  # at most 32 blocks a list
        F.collect_list(F.struct("rest", "n", "a", "b")).alias("blocks"),
        F.min("a").alias("a"), F.max("b").alias("b"), F.max("own").alias("own")).where("a < b and own = band")
    need = lambda n, m: F.ceil(F.greatest(n, m) * num / den - 1e-9)  # noqa: E731  overlap that similarity t takes at least
    reach = F.exists("blocks", lambda x: ((x["a"] != F.col("node")) | (x["b"] != F.col("node")))
                     & (F.least(F.col("rest"), x["rest"]) >= need(F.col("n"), x["n"])))
    left = e.join(lists.select("s", "band", "blocks"), ["s", "band"]).where(reach).select("s", "band", "node")
    lead = left.groupBy("s", "band").agg(F.min("node").alias("r"), F.max("node").alias("b")).where("r < b").select("s", "band", "r")
    return left.join(lead, ["s", "band"]).select("r", "node").distinct()


def _blocked(d: DataFrame, block: int) -> DataFrame:
    """Rows of (r, node, ...) dealt to pairs of blocks (r, bi, bj), each in one task and together."""
    size = d.groupBy("r").agg(F.count("*").alias("members"))
    d = d.join(size, "r").withColumn("parts", F.ceil(F.col("members") / block).cast("int")).drop("members")
    d = d.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("other", "parts")
    return d.repartition("r", "bi", "bj").sortWithinPartitions("r", "bi", "bj")


def _by_group(d: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows)`` for the rows (as dicts) of each (r, bi, bj) gives tuples of longs."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(rows: list[dict]) -> pa.RecordBatch:
            got = fn(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in range(len(names))], names=names)

        for b in batches:
            for row in b.to_pylist():
                if held and (held[0]["r"], held[0]["bi"], held[0]["bj"]) != (row["r"], row["bi"], row["bj"]):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return d.mapInArrow(run, schema)


def _apart(rows: list[dict]) -> np.ndarray | bool:
    """Pairs that this pair of blocks looks at: between two blocks, not inside one."""
    if rows[0]["bi"] == rows[0]["bj"]:
        return True
    own = np.array([x["own"] for x in rows])
    return own[:, None] != own[None, :]


def _labels(node: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The smallest node of each row's component."""
    label = node.copy()
    while True:
        low = label.copy()
        for i in range(0, len(label), STRIPE):
            own = np.where(link[i:i + STRIPE], label[None, :], np.iinfo(np.int64).max).min(1)
            low[i:i + STRIPE] = np.minimum(low[i:i + STRIPE], own)
        if (low == label).all():
            return label
        label = low


def near_groups(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """(leader, node) of the members that may have a partner, by their bitmaps."""
    node, n = np.array([x["node"] for x in rows]), np.array([x["n"] for x in rows], np.int64)
    width = min(len(x["flips"]) for x in rows)  # longer ones fold: their bits are the same modulo the shorter width
    flips = np.stack([np.bitwise_xor.reduce(np.frombuffer(x["flips"], np.uint8).reshape(-1, width), axis=0) for x in rows]).view(_U)
    near = np.empty((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        near[i] = np.bitwise_count(flips ^ flips[i]).sum(1, dtype=np.int64) <= (den - num) * (n + n[i]) // (den + num)
        near[i] &= den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])
    np.fill_diagonal(near, False)
    near &= _apart(rows)
    label = _labels(node, near)
    return [(int(a), int(b)) for a, b, some in zip(label, node, near.any(1)) if some]


def differences(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(r, node, nr, n, plus, minus): what a member adds to and lacks of its leader."""
    d = pairs.join(own, "node").join(own.select(F.col("node").alias("r"), F.col("n").alias("nr"), F.col("shingles").alias("rs")), "r")

    def run(batches):
        for b in batches:
            x, xp = _unpack(b, "shingles")
            r, rp = _unpack(b, "rs")
            plus, minus = [], []
            for i in range(b.num_rows):
                xs, rs = x[xp[i]:xp[i + 1]], r[rp[i]:rp[i + 1]]
                plus.append(np.setdiff1d(xs, rs, True).tobytes())
                minus.append(np.setdiff1d(rs, xs, True).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(plus, pa.binary()), pa.array(minus, pa.binary())],
                                             names=["r", "node", "nr", "n", "plus", "minus"])

    return d.select("r", "node", "nr", "n", "shingles", "rs").mapInArrow(run, "r long, node long, nr long, n long, plus binary, minus binary")


def shared_counts(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two rows share."""
    n = len(tokens)
    out = np.zeros((n, n), np.int32)
    row = np.repeat(np.arange(n), [len(t) for t in tokens])
    if not len(row):
        return out
    code = np.unique(np.concatenate(tokens), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    size = np.diff(np.append(first, len(code)))
    for f in np.unique(size[(size > 1) & (size <= 16)]).tolist():  # rare tokens: their few pairs
        rows = row[first[size == f][:, None] + np.arange(f)]
        i, j = np.triu_indices(f, 1)
        pair, times = np.unique((rows[:, i] * n + rows[:, j]).ravel(), return_counts=True)
        i, j = np.divmod(pair, n)
        out[i, j] += times.astype(np.int32)
        out[j, i] += times.astype(np.int32)
    many = np.flatnonzero(size > 16)
    for k in range(0, len(many), DENSE_COLUMNS):  # common tokens: products of 0/1 columns
        part = many[k:k + DENSE_COLUMNS]
        m = np.zeros((n, len(part)), np.float32)
        for c, g in enumerate(part.tolist()):
            m[row[first[g]:first[g] + size[g]], c] = 1
        out += (m @ m.T).astype(np.int32)
    return out


def group_links(rows: list[dict], num: int, den: int) -> list[tuple[int, int, int]]:
    """Node, smallest node of its component here, links that are counted here."""
    node = np.array([x["node"] for x in rows])
    n = np.array([x["n"] for x in rows], np.int64)
    plus, minus = ([np.frombuffer(x[k], _U) for x in rows] for k in ("plus", "minus"))
    lack = np.array([len(x) for x in minus])
    # added and lacking shingles cannot be equal: the first are not in r, the second are
    same = shared_counts([np.concatenate(x) for x in zip(plus, minus)])
    link = np.empty(same.shape, bool)
    for i in range(0, len(n), STRIPE):
        over = rows[0]["nr"] - lack[i:i + STRIPE, None] - lack[None, :] + same[i:i + STRIPE]
        link[i:i + STRIPE] = (den + num) * over >= num * (n[i:i + STRIPE, None] + n[None, :])
    np.fill_diagonal(link, False)
    link &= _apart(rows)
    label = _labels(node, link)
    copies = np.array([x["copies"] for x in rows], np.int64)
    counted = link.copy()
    several = [i for i, x in enumerate(rows) if len(x["leaders"]) > 1]
    if len(several) > 1:  # two that meet under several leaders count under the smallest
        lead = {i: set(rows[i]["leaders"]) for i in several}
        sub = np.array(several)
        for a, b in zip(*np.nonzero(link[np.ix_(sub, sub)])):
            i, j = several[a], several[b]
            counted[i, j] = min(lead[i] & lead[j]) == rows[0]["r"]
    total = [x for i in range(0, len(n), STRIPE) for x in (counted[i:i + STRIPE] @ copies).tolist()]
    return list(zip(node.tolist(), label.tolist(), total))


def links(diffs: DataFrame, copies: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(node, low, k): edges to the smallest node of the local component, and link counts."""
    leaders = diffs.groupBy("node").agg(F.collect_set("r").alias("leaders"))  # a few, at most one a prefix shingle and block
    d = diffs.join(leaders, "node").join(copies.select("node", "copies"), "node")
    return _by_group(_blocked(d, block), lambda rows: group_links(rows, num, den), "node long, low long, k long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest node of the component of each node with an edge.
    ``edges`` (node, low) has low < node; large-star and small-star rounds alternate
    until the edges stand still, each round a table in the shared folder."""
    edges = materialise(edges.select("node", "low").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())
    state = mark(edges)
    while state[0]:
        both = edges.union(edges.select("low", "node"))
        low = both.groupBy("node").agg(F.least(F.min("low"), F.first("node")).alias("m"))
        large = both.join(low, "node").where("low > node and low != m").select(F.col("low").alias("node"), F.col("m").alias("low")).distinct()
        least = large.groupBy("node").agg(F.min("low").alias("m"))
        small = large.join(least, "node").select(F.explode(F.array(
            F.struct("node", F.col("m").alias("low")), F.struct(F.col("low").alias("node"), F.col("m").alias("low")))).alias("e"))
        new_edges = materialise(small.select("e.*").where("node != low").distinct(), "edges")
        release(edges)
        edges, old = new_edges, state
        state = mark(edges)
        if state == old:
            break
    return edges


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
                       num: int = 90, den: int = 100, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by
    links) and n_links (documents linked directly, copies included)."""
    if not 0 < num <= den:
        raise ValueError("the similarity num / den lies in (0, 1]")
    texts = text_rows(docs, id_col, text_col)
    rows = materialise(set_rows(texts, n), "sets")
    sets = rows.where(F.col("n").isNotNull()).select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    copies = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
    flips = rows.where(F.col("id").isNotNull() & F.col("node").isNotNull()).select("node", "n", "flips")
    frequent = frequent_shingles(rows.where(F.col("s").isNotNull()), hot)
    entries = materialise(prefix_entries(texts, n, frequent, num, den), "entries")
    pairs = materialise(leader_pairs(entries, num, den), "leader-pairs")
    release(entries)
    seen = pairs.join(flips.join(pairs.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node")
    near = _by_group(_blocked(seen, block), lambda g: near_groups(g, num, den), "r long, node long").distinct()
    met, pairs = pairs, materialise(near, "near-pairs")
    release(met)
    own = materialise(member_sets(texts, n, pairs.select("node").distinct()), "member-sets")  # leaders are members too
    diffs = materialise(differences(pairs, own), "differences")
    release(own, pairs)
    found = materialise(links(diffs, copies, num, den, block), "links")
    release(diffs)
    comp = connected(found.where("low < node").select("node", "low"))
    count = found.groupBy("node").agg(F.sum("k").alias("k"))
    nodes = copies.join(comp, "node", "left").join(count, "node", "left").withColumn("low", F.coalesce("low", "node"))
    first = nodes.groupBy("low").agg(F.min("low_id").alias("component_id"))
    nodes = nodes.join(first, "low").select("node", "component_id", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sets.join(nodes, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
