"""The commit log of runs: failed writes, two writers, quarantine of broken metrics."""

import pytest
from pyspark.sql import functions as F

from mojiframe.sources import io as IO
from mojiframe.sources import runlog
from mojiframe.sources.runlog import RunLog


def rows(spark, *runs, p=0.5):
    return spark.createDataFrame([(r, i, 0, 1, p) for r in runs for i in range(3)], "run string, id long, y_true int, y_pred int, p double")


def held(spark, path):
    return sorted({(r.run, r.p) for r in IO.read_predictions(spark, path).collect()})


def test_a_failed_write_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.write_predictions(rows(spark, "a"), path)
    bad = rows(spark, "b").withColumn("p", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.1))
    with pytest.raises(Exception, match="lost"):
        IO.write_predictions(bad, path, existing="keep")
    runlog.stage(rows(spark, "b", p=0.2), path)  # data written, then the job died
    assert held(spark, path) == [("a", 0.5)]
    IO.write_predictions(rows(spark, "a", "b", p=0.9), path, existing="keep")
    assert held(spark, path) == [("a", 0.5), ("b", 0.9)]


@pytest.mark.parametrize("existing", ["error", "keep"])
def test_two_writers(spark, tmp_path, existing):
    """Both look at an empty log and write; the first to commit has the run they share."""
    path = str(tmp_path / "t")
    one, two = runlog.stage(rows(spark, "a", "b", p=0.1), path), runlog.stage(rows(spark, "b", "c", p=0.2), path)
    log = RunLog(spark, path)
    assert log.commit(*two, existing) == ["b", "c"]
    if existing == "error":
        with pytest.raises(FileExistsError, match="b"):
            log.commit(*one, existing)
        log.discard(one[0])
        want = [("b", 0.2), ("c", 0.2)]
    else:
        assert log.commit(*one, existing) == ["a"]
        want = [("a", 0.1), ("b", 0.2), ("c", 0.2)]
    assert held(spark, path) == want
    assert IO.read_predictions(spark, path, ["b"]).count() == 3


def test_the_number_of_a_record_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "t")
    log = RunLog(spark, path)
    log.fs.mkdirs(log.folder)
    assert log._claim(0, {"attempt": "x", "runs": ["a"]})
    assert not log._claim(0, {"attempt": "y", "runs": ["a"]})
    assert log.runs() == {"a": "x"}
    seen, real = [], log.records

    def late():  # another writer takes the next number between the look at the log and the claim
        out = real()
        if not seen:
            seen.append(log._claim(1, {"attempt": "z", "runs": ["b"]}))
        return out

    log.records = late
    with pytest.raises(FileExistsError):
        log.commit("w", ["b", "c"], "error")
    log.records = real
    assert log.runs() == {"a": "x", "b": "z"}


def test_committed_rows_are_not_discarded(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.write_predictions(rows(spark, "a"), path)
    with pytest.raises(ValueError):
        RunLog(spark, path).discard(RunLog(spark, path).runs()["a"])


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        IO.read_predictions(spark, str(tmp_path / "none"))
    path = str(tmp_path / "t")
    IO.write_predictions(rows(spark, "a"), path)
    assert IO.read_predictions(spark, path, ["other"]).count() == 0


def test_broken_metrics_are_set_aside(spark, tmp_path):
    for run, text in {"good": '{"accuracy": 0.5, "macro_f1": 0.4}', "cut": '{"accuracy": 0.5, "mac', "lacks": '{"accuracy": 0.5}',
                      "wild": '{"accuracy": 1.5, "macro_f1": 0.4}', "words": '{"accuracy": "much", "macro_f1": 0.4}'}.items():
        (tmp_path / f"m/run={run}").mkdir(parents=True)
        (tmp_path / f"m/run={run}/metrics.json").write_text(text + "\n")
    good, failed = IO.read_run_metrics(spark, str(tmp_path / "m"), "accuracy double, macro_f1 double")
    assert [tuple(r) for r in good.select("run", "accuracy", "macro_f1").collect()] == [("good", 0.5, 0.4)]
    assert dict(map(tuple, failed.collect())) == {"cut": "malformed metrics", "lacks": "macro_f1 is missing",
                                                   "wild": "accuracy is not between 0 and 1", "words": "malformed metrics"}
    assert IO.read_run_metrics(spark, str(tmp_path / "none"), "accuracy double, macro_f1 double")[1].count() == 0
