"""Quoted CSV in splits, against Python's csv module."""

import csv
import io
import random

import pytest

from mojiframe.sources import csvlines
from mojiframe.sources import io as IO

SCHEMA = "a string, b string, c int"


def content(seed: int, rows: int, end: str) -> tuple[str, list[list[str]]]:
    rng = random.Random(seed)
    parts = ["x", '"', "\n", ",", " ", "é", "\U0001F644", "word", "\n\n", '""', "\r\n", "long " * 12]
    data = [["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) + "z", f"k{i}", str(i)] for i in range(rows)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["a", "b", "c"])
    w.writerows(data)
    return out.getvalue(), data


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [61, 500, 1 << 20])
def test_records_and_ids_over_uneven_files(spark, tmp_path, small_splits, size, end):
    small_splits(size)
    want = []
    for k, rows in enumerate([3, 250, 0, 40]):
        text, data = content(k, rows, end)
        (tmp_path / f"f{k}.csv").write_text(text, newline="", encoding="utf-8")
        want += data
    (tmp_path / "f5.csv").write_text("", encoding="utf-8")
    df = csvlines.read_csv(spark, str(tmp_path), IO.T._parse_datatype_string(SCHEMA), "id")
    got = [[r.a, r.b, str(r.c)] for r in df.orderBy("id").collect()]
    assert got == want
    assert [r.id for r in df.select("id").orderBy("id").collect()] == list(range(len(want)))


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    small_splits(50)
    long = "line one\n\n" * 40 + '"quoted"\n' * 30
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows([["a", "b", "c"], ["s", "t", "1"], [long, "t", "2"], ["s", long, "3"]])
    (tmp_path / "f.csv").write_text(buffer.getvalue() + "\n\nlast,one,4", encoding="utf-8")
    got = csvlines.read_csv(spark, str(tmp_path), id_col="id").orderBy("id").collect()
    assert [(r.id, r.a, r.b, r.c) for r in got] == [(0, "s", "t", "1"), (1, long, "t", "2"), (2, "s", long, "3"), (3, "last", "one", "4")]


def test_one_file_is_read_in_many_tasks(spark, tmp_path, small_splits):
    small_splits(2_000)
    text, data = content(9, 400, "\n")
    (tmp_path / "one.csv").write_text(text, encoding="utf-8")
    df = csvlines.read_csv(spark, str(tmp_path / "one.csv"), id_col="id")
    assert df.rdd.getNumPartitions() >= len(text.encode()) // 2_000 > 5
    assert df.count() == len(data)


def test_quotes_that_do_not_pair(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,"open\n', encoding="utf-8")
    with pytest.raises(ValueError, match="f.csv"):
        csvlines.read_csv(spark, str(tmp_path))


def test_header_names_and_bom(spark, tmp_path):
    (tmp_path / "f.csv").write_text('﻿,"two\nlines",c\n0,x,\n', encoding="utf-8")
    df = csvlines.read_csv(spark, str(tmp_path))
    assert df.columns == ["_c0", "two\nlines", "c"] and [tuple(r) for r in df.collect()] == [("0", "x", None)]


def test_malformed_rows_fail(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c\n1,2,not a number\n", encoding="utf-8")
    with pytest.raises(Exception):
        csvlines.read_csv(spark, str(tmp_path), IO.T._parse_datatype_string(SCHEMA)).collect()


def test_memory_does_not_follow_arrow_batches():
    """Long batches are gone through in stretches; records come out the same."""
    import tracemalloc

    import pyarrow as pa

    lines = [f'{i},"a ""b"",' if i % 3 == 0 else 'c",d' if i % 3 == 1 else f"{i}," + "words " * 500 for i in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(lines), pa.int64()), pa.array(lines)], names=["split", "value"])
    bytes_ = sum(map(len, lines))

    class Splits:
        value = {1: (False, 0, 0, -1, 0)}

    tracemalloc.start()
    (count,) = csvlines._count(iter([batch]))
    n = 0
    for b in csvlines._assemble(Splits, False)(iter([batch])):
        assert b.column("id").to_pylist() == list(range(n, n + b.num_rows))
        assert all(x.count('"') % 2 == 0 for x in b.column("text").to_pylist())
        n += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 == count.column("outside")[0].as_py()
    assert peak < 10 * bytes_ and peak < 80 * csvlines.STRETCH, (peak, bytes_)
