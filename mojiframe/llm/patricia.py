"""Exact de-duplication by Patricia-trie owners (operator 13).

Texts are equal when identical after every run of white space ``[\\x20\\x09-\\x0D]+``
became one space.  Whole normalised byte strings go into compressed radix tries;
a terminal node stores the smallest identifier of its text:

1. Every task of the scan keeps a trie of its own texts, so that any number of
   copies leaves it as one owner (text, smallest id, count).  Beyond
   ``trie_bytes`` the heaviest subtrees are written out and dropped; a text that
   comes again simply gets another owner.
2. Owners are dealt out by (length, hash) of the text: equal texts meet, other
   texts of an equal hash stay apart in the trie.  Each task inserts the full
   strings; beyond ``trie_bytes`` it spills by subtree: the owners below the
   heaviest branches leave as rows, a stub stays, and what comes to that branch
   later follows them.  Spilled owners go on into a round of twice as many parts.
3. Rows know the terminal of their task, terminals know their owner: one join
   on narrow columns.  No group of copies is ever gathered: a hot text is one
   owner a task.

Defined results: null counts as empty; null ids come after all others, so a
group's ``keep_id`` is null only where all its ids are; of rows that share the
smallest id the first in its task stays, so one row of each group is kept; extra
columns are carried only where ``keep`` names them; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiframe.llm.common import give_back, materialise, release, text_rows

#: Bytes of a trie, labels and nodes, before it spills.
TRIE_BYTES = 64 << 20
#: Text bytes that one part of the owners' shuffle is planned for.
PART_BYTES = 32 << 20
NODE_BYTES = 250
#: Rows of an output batch, and their text bytes.
OUT_ROWS, OUT_BYTES = 5000, 4 << 20

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalised(text: bytes | None) -> bytes:
    """Runs of white space as one space."""
    t = (text or b"").translate(_SPACES)
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``text[at:]``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """An edge's label and the node it leads to; ``owner`` is None where no text ends."""

    __slots__ = ("label", "owner", "below", "stub")

    def __init__(self, label: bytes):
        self.label, self.owner, self.below, self.stub = label, None, {}, False


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root = Node(b"")
        self.bytes = self.texts = 0

    def find(self, text: bytes) -> Node | None:
        """The node at which ``text`` ends, made if need be; None inside a spilled subtree."""
        node, at, size = self.root, 0, len(text)
        while True:
            if node.stub:
                return None
            if at == size:
                return node
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                self.bytes += NODE_BYTES + size - at
                return child
            label = child.label
            if not text.startswith(label, at):
                k = _common(label, text, at)
                upper = Node(label[:k])
                child.label = label[k:]
                upper.below[child.label[0]] = child
                node.below[text[at]] = child = upper
                self.bytes += NODE_BYTES
            at += len(child.label)
            node = child

    @staticmethod
    def owners(top: Node, path: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(text, owner) of every terminal below ``top``, in byte order."""
        stack, labels = [(top, 0)], [path]
        while stack:
            node, depth = stack.pop()
            del labels[depth + 1:]
            labels.append(node.label)
            if node.owner is not None:
                yield b"".join(labels), node.owner
            stack += [(node.below[b], depth + 1) for b in sorted(node.below, reverse=True)]

    @staticmethod
    def _weight(top: Node) -> tuple[int, int]:
        """Bytes and terminals of a subtree."""
        size = texts = 0
        stack = [top]
        while stack:
            node = stack.pop()
            size += NODE_BYTES + len(node.label)
            texts += node.owner is not None
            stack += node.below.values()
        return size, texts

    def spill(self, limit: int, stubs: bool) -> Iterator[tuple[bytes, object]]:
        """The owners of the heaviest subtrees, which are dropped until at most ``limit`` bytes are
        left; with ``stubs`` their places stay marked."""
        node, path = self.root, b""
        while len(node.below) == 1 and node.owner is None:
            node = next(iter(node.below.values()))
            path += node.label
        if not node.below:  # a single text
            return
        weights = sorted(((*self._weight(c), b) for b, c in node.below.items() if not c.stub), reverse=True)
        for size, texts, b in weights:
            if self.bytes <= limit:
                break
            child = node.below[b]
            yield from self.owners(child, path)
            self.bytes -= size
            self.texts -= texts
            if stubs:
                child.below, child.owner, child.stub = {}, None, True
                self.bytes += NODE_BYTES + len(child.label)
            else:
                del node.below[b]


class _Out:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema, text_at: int):
        self.schema, self.text_at = schema, text_at
        self.clear()

    def clear(self) -> None:
        self.rows, self.bytes = [], 0

    def add(self, *row) -> bool:
        self.rows.append(row)
        self.bytes += len(row[self.text_at] or b"")
        return len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.clear()
        return out


def _least(a, b):
    """The smaller of two (id, place), null ids last."""
    if a[0] is None or b[0] is None:
        return min(a, b, key=lambda x: (x[0] is None, x[1]))
    return min(a, b)


def _local_owners(rows: DataFrame, n_keep: int, trie_bytes: int) -> DataFrame:
    """Rows with the terminal (part, node) of their text, and the owners of the task's terminals (text not null)."""
    kind = rows.schema["id"].dataType.simpleString()
    kept = [rows.schema[f"keep{i}"] for i in range(n_keep)]
    ddl = ", ".join([f"part int, node long, id {kind}, place long, text binary, n long",
                     *[f"keep{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nodes, place, trie, out = TaskContext.get().partitionId(), 0, 0, Trie(), None

        def flush(found):
            for text, (node, least, n) in found:
                if out.add(part, node, *least, text, n):
                    yield padded(out.batch())

        def padded(b):
            return pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, t) for t in kept_types]], names=names)

        for b in batches:
            if out is None:
                kept_types = [b.column(2 + i).type for i in range(n_keep)]
                schema = pa.schema([("part", pa.int32()), ("node", pa.int64()), ("id", b.column(0).type), ("place", pa.int64()),
                                    ("text", pa.binary()), ("n", pa.int64())])
                names, out = [*schema.names, *[f"keep{i}" for i in range(n_keep)]], _Out(schema, 4)
            places, at = range(place, place + b.num_rows), []
            place += b.num_rows
            for ident, text, row in zip(b.column(0).to_pylist(), b.column(1), places):
                found = trie.find(normalised(text.as_py()))
                if found.owner is None:
                    found.owner = [nodes, (ident, row), 0]
                    nodes += 1
                    trie.texts += 1
                own = found.owner
                own[1] = _least(own[1], (ident, row))
                own[2] += 1
                at.append(own[0])
                if trie.bytes > trie_bytes and trie.texts > 1:
                    yield from flush(trie.spill(trie_bytes // 2, stubs=False))
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * b.num_rows, pa.int32()), pa.array(at, pa.int64()), b.column(0), pa.array(places, pa.int64()), none,
                 pa.nulls(b.num_rows, pa.int64()), *b.columns[2:]], names=names)
        if out is not None:
            yield from flush(trie.owners(trie.root))
            yield padded(out.batch())
        give_back()

    return rows.mapInArrow(run, ddl)


def _merged_owners(owners: DataFrame, parts: int, trie_bytes: int) -> DataFrame:
    """Owners of equal texts as one: smallest (id, part, place), count, members and digest.
    Rows that still carry their text were spilled and have to go round again."""
    kind = owners.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, part int, place long, n long, members array<struct<part:int,node:bigint>>, digest binary, text binary"
    dealt = owners.repartition(parts, F.octet_length("text"), F.xxhash64("text")).select(
        "id", "part", "place", "n", F.col("members.part").alias("mp"), F.col("members.node").alias("mn"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), None

        def add(own, text, final):
            (ident, (part, place)), n, parts, nodes = own
            members = [{"part": p, "node": m} for p, m in zip(parts, nodes)]
            return out.add(ident, part, place, n, members, hashlib.sha256(text).digest() if final else None, None if final else text)

        for b in batches:
            if out is None:
                member = pa.list_(pa.struct([("part", pa.int32()), ("node", pa.int64())]))
                out = _Out(pa.schema([("id", b.column(0).type), ("part", pa.int32()), ("place", pa.int64()), ("n", pa.int64()),
                                      ("members", member), ("digest", pa.binary()), ("text", pa.binary())]), 6)
            for ident, part, place, n, mp, mn, text in zip(*[c.to_pylist() for c in b.columns[:6]], b.column(6)):
                text = text.as_py()
                found, own = trie.find(text), [(ident, (part, place)), n, mp, mn]
                if found is None:  # a spilled subtree
                    if add(own, text, False):
                        yield out.batch()
                    continue
                if found.owner is None:
                    found.owner = own
                    trie.texts += 1
                else:
                    old = found.owner
                    old[0], old[1] = _least(old[0], own[0]), old[1] + n
                    old[2] += mp
                    old[3] += mn
                if trie.bytes > trie_bytes and trie.texts > 1:
                    for text, own in trie.spill(trie_bytes // 2, stubs=True):
                        if add(own, text, False):
                            yield out.batch()
        if out is not None:
            for text, own in trie.owners(trie.root):
                if add(own, text, True):
                    yield out.batch()
            yield out.batch()
        give_back()

    return dealt.mapInArrow(run, ddl)


def trie_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
               trie_bytes: int = TRIE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, and the columns ``keep``."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col, keep).withColumn("text", F.col("text").cast("binary"))
    local = materialise(_local_owners(rows, len(keep), trie_bytes), "trie-rows")
    texts = local.where(F.col("text").isNotNull()).select(
        "id", "part", "place", "n", F.array(F.struct("part", "node")).alias("members"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    found = []
    while texts is not None:
        merged = materialise(_merged_owners(texts, parts, trie_bytes), "trie-owners")
        found.append(merged)
        left = merged.where(F.col("text").isNotNull())
        texts = None if left.isEmpty() else left.drop("digest")
        parts *= 2
    owners = found[0].where(F.col("text").isNull())
    for more in found[1:]:
        owners = owners.union(more.where(F.col("text").isNull()))
    owners = owners.select(F.explode("members").alias("m"), F.col("id").alias("keep_id"), F.col("part").alias("own_part"),
                           F.col("place").alias("own_place"), F.col("n").alias("group_size"), "digest")
    owners = owners.select(F.col("m.part").alias("part"), F.col("m.node").alias("node"), "keep_id", "own_part", "own_place", "group_size", "digest")
    members = local.where(F.col("text").isNull()).drop("text", "n")
    joined = members.join(owners, ["part", "node"])
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size",
                         ((F.col("part") == F.col("own_part")) & (F.col("place") == F.col("own_place"))).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])


def op13_patricia_dedup(spark, sf_dir: str) -> DataFrame:
    return trie_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS nth, min(doc_id) OVER (PARTITION BY t) AS keep_id,
      count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
