"""Readers/writers: CSV quoting, stray index column, row ids, sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mojiframe.sources import io as IO

CSV = (',tweet,sarcastic,rephrase\n'
       '0,"he said ""hi""\nthere \U0001F644",1,"no he did not"\n'
       '1,plain,0,\n'
       '2,"a, b",0,\n')


def test_csv_quotes_newlines_and_index(spark):
    d = tempfile.mkdtemp(prefix="mf-csv-")
    with open(os.path.join(d, "train.csv"), "w", encoding="utf-8") as f:
        f.write(CSV)
    df = IO.read_labelled_csv(spark, d, IO.TRAIN_SCHEMA)
    assert df.columns == ["tweet", "sarcastic", "rephrase"]
    rows = df.collect()
    assert rows[0].tweet == 'he said "hi"\nthere \U0001F644'
    assert rows[1].rephrase is None and rows[2].tweet == "a, b"
    v = IO.load_train(spark, d).orderBy("id").collect()
    assert [r.id for r in v] == [0, 1, 2] and v[0].has_emoji


def test_row_ids_contiguous_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("x"))
    ids = IO.with_row_ids(df).collect()
    assert sorted(r.id for r in ids) == list(range(1000))
    assert all(r.id * 3 == r.x for r in ids)  # scan order kept


def test_refuse_overwrite_and_partition_pruning(spark):
    d = tempfile.mkdtemp(prefix="mf-preds-") + "/p"
    preds = spark.createDataFrame([("a", 1, 0, 0, 0.1), ("b", 2, 1, 1, 0.9)],
                                  "run string, id long, y_true int, y_pred int, p double")
    IO.write_predictions(preds, d)
    with pytest.raises(Exception):
        IO.write_predictions(preds, d)
    r = IO.read_predictions(spark, d, ["b"])
    assert [x.id for x in r.collect()] == [2]
    assert "PartitionFilters: [isnotnull(run" in r._jdf.queryExecution().executedPlan().toString()


def test_manifest_and_missing_json(spark):
    d = tempfile.mkdtemp(prefix="mf-man-")
    with open(os.path.join(d, "splits.json"), "w") as f:
        f.write('{"train_ids": [0, 2], "dev_ids": [1], "test_file": "t.csv", "seed": 42, "dev_size": 0.15}')
    s = {(r.id, r.split) for r in IO.read_split_manifest(spark, d).collect()}
    assert s == {(0, "train"), (2, "train"), (1, "dev")}
    empty = IO.read_json_table(spark, d + "/nope", IO.PREDICTION_SCHEMA)
    assert empty.count() == 0


def test_manifests_of_bounded_arrays(spark):
    d = tempfile.mkdtemp(prefix="mf-mans-")
    rows = [(i, "dev" if i % 7 == 0 else "train") for i in range(1000)] + [(5, "train"), (1000, "test")]
    spark.createDataFrame(rows, "id long, split string").repartition(3).write.parquet(f"{d}/ids")
    IO.write_split_manifest(spark.read.parquet(f"{d}/ids"), f"{d}/docs", 42, 0.15, "t.csv", per_document=64)
    files = [f for f in os.listdir(f"{d}/docs") if f.endswith(".json")]
    assert len(files) >= 16
    docs = spark.read.schema(IO.MANIFEST_SCHEMA).json(f"{d}/docs").collect()
    assert len(docs) == len(files) and max(len(r.train_ids) + len(r.dev_ids) for r in docs) <= 64
    assert {(r.test_file, r.seed, r.dev_size) for r in docs} == {("t.csv", 42, 0.15)}
    got = sorted((r.id, r.split) for r in IO.read_split_manifest(spark, f"{d}/docs").collect())
    assert got == sorted(x for x in rows if x[1] != "test")      # a repeated id stays repeated
    empty = f"{d}/none"
    IO.write_split_manifest(spark.read.parquet(f"{d}/ids").where("id < 0"), empty, 42, 0.15, "t.csv")
    assert IO.read_split_manifest(spark, empty).count() == 0


def test_stored_runs_are_discovered(spark):
    from mojiframe.sources import runlog
    from mojiframe.sources import runs as RN

    d = tempfile.mkdtemp(prefix="mf-found-")
    preds = spark.createDataFrame([("b", 1, 1, 1, 0.9), ("a", 1, 1, 0, 0.1), ("_final", 1, 1, 1, 0.9), ("old", 1, 1, 1, 0.9)],
                                  "run string, id long, y_true int, y_pred int, p double")
    IO.write_predictions(preds, f"{d}/p")
    runlog.stage(preds.limit(1).selectExpr("'half' AS run", "id", "y_true", "y_pred", "p"), f"{d}/p")
    for run, text in {"a": '{"run_name": "a", "seed": 43}', "b": "run_name: b\nseed: 44\n", "_final": "seed: 43\n",
                      "half": "seed: 43\n", "untrained": "seed: 43\n"}.items():
        os.makedirs(f"{d}/c/run_folder={run}")
        with open(f"{d}/c/run_folder={run}/config.txt", "w") as f:
            f.write(text)
    found = lambda seed=None: [(r.run, r.seed) for r in RN.discover_stored_runs(spark, f"{d}/p", f"{d}/c", seed).collect()]
    assert found() == [("a", 43), ("b", 44)]                     # sorted; "old" has no config, "half" no commit
    assert found(44) == [("b", 44)] and found(1) == []


def test_run_names_both_ways(spark):
    from pyspark.sql import functions as F

    from mojiframe.sources import runs as RN

    rows = [("gated", "x_text", 2e-5, 4, 16, 43), ("text_only", "x_full", 0.01, 1, 8, 0), ("concat", "my_roberta_col", 5e-4, 12, 32, 7)]
    df = spark.createDataFrame(rows, "m string, c string, lr double, e int, b int, s int")
    df = df.withColumn("run", RN.make_run_name(*[F.col(x) for x in ("m", "c", "lr", "e", "b", "s")])).withColumn("f", RN.run_name_fields(F.col("run")))
    for r in df.collect():
        assert tuple(r.f) == (r.m, r.c, r.lr, r.e, r.b, r.s), r.run
    other = spark.createDataFrame([("_final",), ("",), (None,)], "run string").select(RN.run_name_fields(F.col("run")).alias("f")).collect()
    assert [r.f for r in other] == [None] * 3


def test_train_dev_load_and_sinks(spark):
    from mojiframe.operators.splits import stratified_split
    from mojiframe.sources import runs as RN

    d = tempfile.mkdtemp(prefix="mf-s5-")
    csv = os.path.join(d, "csv")
    os.makedirs(csv)
    with open(os.path.join(csv, "train.csv"), "w", encoding="utf-8") as f:
        f.write(",tweet,sarcastic,rephrase\n" + "".join(
            f'{i},"text {i} \U0001F644",{int(i % 4 == 0)},\n' for i in range(40)))
    full = IO.load_train(spark, csv)
    splits = stratified_split(full.withColumnRenamed("sarcastic", "label"), 0.25, 42)
    IO.write_splits(splits, d + "/splits", 42, 0.25, "test.csv")
    train, dev = IO.load_train_dev(spark, csv, d + "/splits/ids")
    assert train.count() + dev.count() == 40 and dev.count() == 10
    # The test file gets variants too (text column detection by name)
    test = IO.load_test(spark, csv, IO.TRAIN_SCHEMA)
    assert "x_desc" in test.columns
    # K7: ignore keeps what is there; K8/K9 JSON sinks round-trip
    out = d + "/lb"
    IO.write_json_table(train.select("id", "tweet"), out)
    IO.write_json_table(dev.select("id", "tweet"), out, mode="ignore")
    assert spark.read.json(out).count() == train.count()
    # Checkpoint value, else config value, else default
    df = spark.createDataFrame([(None, 64), (None, None), (32, 64)], "ck int, cfg int")
    vals = [r.max_len for r in RN.with_fallbacks(df, "max_len", "ck", "cfg", 128).collect()]
    assert vals == [64, 128, 32]
