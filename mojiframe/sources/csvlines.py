"""Quoted CSV records with line breaks, from files that are split.

``multiLine`` reads a file in one task, since only its start tells whether a
line lies inside quotes.  Here files are read as lines, in splits.  A quote
opens or closes, and a doubled one does both, so a line begins inside quotes when the quotes before
it in its file are odd in number:

1. One pass counts, for each split, its quotes modulo two and the records that
   start in it, both for a split that begins outside and for one that begins
   inside quotes.  Running sums over the splits (one row each, in the order of
   file path and position) then give every split its state and the place of its
   first record.
2. A second pass puts the lines of a split together.  A record that runs over
   the end of its split is left in pieces, at most one at either end; pieces are
   the only rows that are shuffled.

Places follow file order, so row ids do too.  The files must be as RFC 4180 has
them (a field with quotes is quoted); a file whose quotes do not pair is an error."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, NEWLINE, RETURN = 34, 10, 13
#: Bytes of lines that are looked at together (a longer line is looked at alone): numpy's arrays of
#: places hold some 60 bytes for each of them, whatever Arrow's batches bring.
STRETCH = 1 << 20


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column."""
    col = col.cast(pa.large_binary())
    _, places, data = col.buffers()
    at = np.frombuffer(places, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(split, bytes, line offsets) of stretches of one split, of at most ``STRETCH`` bytes or one line."""
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        raw, at = _buffer(b.column(1))
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cut, cut[1:]):
            while i < j:
                to = min(j, max(i + 1, int(np.searchsorted(at, at[i] + STRETCH, "right")) - 1))
                yield int(keys[i]), raw[at[i]:at[to]], at[i:to + 1] - at[i]
                i = to


def _odd(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of quotes modulo two of each line, with a 0 before the first as running state."""
    quotes = np.append(0, np.cumsum(raw == QUOTE))[at]
    return (quotes - quotes[0]) & 1


def _blank(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines that hold nothing, or a carriage return alone."""
    size = np.diff(at)
    first = raw[np.minimum(at[:-1], len(raw) - 1)] if len(raw) else np.zeros(len(size), np.uint8)
    return (size == 0) | ((size == 1) & (first == RETURN))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["split", "odd", "outside", "inside"]
    found: dict[int, list[int]] = {}
    for split, raw, at in _runs(batches):
        state, blank = _odd(raw, at), _blank(raw, at)
        own = found.setdefault(split, [0, 0, 0])
        starts = [int(((state[:-1] == s) & ~blank).sum()) for s in (0, 1)]
        own[1] += starts[own[0]]      # the split began outside quotes
        own[2] += starts[1 - own[0]]  # it began inside
        own[0] ^= int(state[-1])
    columns = [list(found), *[[x[k] for x in found.values()] for k in range(3)]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


class _Assembler:
    """Lines of one split put together; ``pending`` holds the lines of a record that is not at its end."""

    def __init__(self, inside: bool, place: int, number: int, header: int, files: int):
        self.state, self.place, self.number = int(inside), place - inside, number
        self.header, self.files = header, files
        self.head, self.pending = bool(inside), []

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Row ids; the header of the n-th file has -n."""
        return np.where(places == self.header, -self.files, places - self.files)

    def own(self) -> int:
        return int(self.ids(np.array([self.place]))[0])

    def add(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], tuple | None]:
        """Ids and texts of the records that end here and are whole; the piece that the split began with, if it ends here."""
        state = _odd(raw, at) ^ self.state
        before, after = state[:-1], state[1:]
        skip = (before == 0) & _blank(raw, at)
        end = (after == 0) & ~skip                                    # a record's last line
        size = np.diff(at) + (~end & ~skip)                           # a line break follows all others
        size[skip] = 0
        stop = np.cumsum(size)
        joined = np.full(int(stop[-1]), NEWLINE, np.uint8)
        text = np.repeat(~skip, np.diff(at))
        to = np.repeat(stop - size - at[:-1], np.diff(at)) + np.arange(len(raw))
        joined[to[text]] = raw[text]
        cut = np.append(0, stop[end])
        view = joined.tobytes()
        records = [view[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        piece = None
        if records and self.pending:
            records[0] = b"".join([*self.pending, records[0]])
            self.pending = []
        if view[cut[-1]:]:
            self.pending.append(view[cut[-1]:])
        if records and self.head:
            piece, records, self.head = (self.own(), self.number, records[0]), records[1:], False
            self.place += 1
        places = np.arange(self.place, self.place + len(records))
        self.place += len(records)
        self.state = int(state[-1])
        return self.ids(places), records, piece

    def rest(self) -> tuple | None:
        """What the split ends with, inside a record."""
        return (self.own(), self.number, b"".join(self.pending).removesuffix(b"\n")) if self.pending else None


def _assemble(splits, pieces: bool):
    """The records that are whole, or only the pieces of the others."""
    names = ["id", "number", "text"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, numbers, texts = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_, now = splits.value, None, None
        for split, raw, at in _runs(batches):
            if split != now:
                if pieces and open_ is not None and (rest := open_.rest()):
                    yield out([rest])
                if split not in known:
                    raise RuntimeError("the files or the settings of their splits changed while they were read")
                open_, now = _Assembler(*known[split]), split
            ids, records, piece = open_.add(raw, at)
            if pieces:
                if piece:
                    yield out([piece])
            elif records:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(records, pa.binary()).cast(pa.string(), safe=False)], names=names)
        if pieces and open_ is not None and (rest := open_.rest()):
            yield out([rest])

    return run


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, text): every record but blank lines.  Rows count from 0 in file order, files by path; the header of the n-th file has -n."""
    conf = spark.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:  # else splits would follow the number of executors alive
        conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    key = F.xxhash64("file", "start").alias("split")
    counts = lines.select(key, "value").mapInArrow(_count, "split long, odd long, outside long, inside long")
    # one row a split from here on
    order = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    t = counts.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("odd", "outside", "inside")])
    t = t.join(lines.select("file", "start", key).distinct(), "split")
    t = t.withColumn("state", F.coalesce(F.sum("odd").over(own), F.lit(0)) % 2)
    t = t.withColumn("records", F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside")))
    t = t.withColumn("place", F.coalesce(F.sum("records").over(order), F.lit(0)))
    rows = t.select("split", "file", "state", "odd", "records", "place").orderBy("file", "start").collect()
    ends = {r.file: (r.state + r.odd) % 2 for r in rows}
    if any(ends.values()):
        raise ValueError("quotes do not pair in " + ", ".join(f for f, x in ends.items() if x))
    known, broken, header, files = {}, [], 0, 0
    for number, r in enumerate(rows):
        if not number or rows[number - 1].file != r.file:
            started = False
        if r.records and not started:
            header, files, started = r.place, files + 1, True
        known[r.split] = (bool(r.state), r.place, number, header, files)
        if r.state:  # a record runs over from the split before
            broken += [rows[number - 1].split, r.split]
    shared = spark.sparkContext.broadcast(known)
    schema = "id long, number long, text string"
    records = lines.select(key, "value").mapInArrow(_assemble(shared, False), schema).select("id", "text")
    if broken:
        marked = spark.createDataFrame([(x,) for x in sorted(set(broken))], "split long")
        pieces = lines.select(key, "value").join(F.broadcast(marked), "split", "left_semi").mapInArrow(_assemble(shared, True), schema)
        whole = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "text"))).alias("p"))
        records = records.union(whole.select("id", F.array_join(F.col("p.text"), "\n").alias("text")))
    bare = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return records.select("id", bare.alias("text"))


OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}


def header_names(records: DataFrame) -> list[str]:
    """Column names of the first file's header; a column without a name is ``_c`` and its number."""
    head = records.where("id = -1").first()
    if head is None:
        raise ValueError("no header: the files hold no line")
    names = next(csv.reader([head.text.removeprefix("\ufeff")]))
    return [n or f"_c{i}" for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, id_col: str | None = None) -> DataFrame:
    """The rows of CSV files with headers, by ``schema`` or, without one, all strings by the first file's header;
    with ``id_col`` their number in file order."""
    records = csv_records(spark, path)
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header_names(records)])
    names = [f"`{f.name.replace('`', '``')}`" for f in schema.fields]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema.fields))
    parsed = records.where("id >= 0").select("id", F.from_csv("text", ddl, OPTIONS).alias("r"))
    columns = [F.col(f"r.{n}").alias(f.name) for n, f in zip(names, schema.fields)]
    return parsed.select(*columns, *([F.col("id").alias(id_col)] if id_col else []))
