"""Crash-safe appending: a run with manifest, ledger and phases, and tails of interrupted files."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from twinfold.operators.checks import ValidationError
from twinfold.sources import records
from twinfold.streaming import append, runs

EASY, DOWN = "example_id string, easy double", "example_id string, easy double, s double"
PHASES = [runs.Phase("easy", EASY), runs.Phase("downstream", DOWN, after="easy", same=("easy",))]


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def dataset(spark, ids="abcd"):
    return spark.createDataFrame([(x,) for x in ids], "example_id string")


def run_of(spark, folder, ids="abcd", config=None):
    return runs.Run(spark, str(folder), dataset(spark, ids), PHASES, config or {"seed": 1})


def finish(query):
    query.awaitTermination(120)


FILES = [[{"example_id": "a", "easy": 1.0}, {"example_id": "a", "easy": 1.0}, {"example_id": "zz", "easy": 0.0}], [{"example_id": "b", "easy": 2.0}, {"example_id": "a", "easy": 5.0}, {"example_id": "c", "easy": 3.0}]]


def state(run):
    rows = sorted((r.example_id, r.easy, r.batch) for r in run.records("easy").collect())
    rejects = sorted((r.example_id, r.easy, r.reason, r.batch) for r in run.rejects("easy").collect())
    return rows, rejects, sorted(map(tuple, run.ledger("easy").collect()))


def drive(run, inbox, crash=None):
    """Both files, a batch each; crash(batch) is called while the second one runs and may set a fault. The query is started again after it."""
    for k, rows in enumerate(FILES):
        put(inbox, f"{k}.json", rows)
        if k == 1 and crash:
            with pytest.raises(Exception, match="crash"):
                with crash():
                    finish(run.start("easy", inbox))
        finish(run.start("easy", inbox))
    return state(run)


@pytest.mark.parametrize("point", ["before rejects", "after rejects", "after rows", "half of the rows", "after the entry", "before the commit"])
def test_a_crash_anywhere_changes_nothing(spark, tmp_path, monkeypatch, point):
    want = drive(run_of(spark, tmp_path / "smooth").open(), str(tmp_path / "in1"))
    assert want[0] == [("a", 1.0, 0), ("b", 2.0, 1), ("c", 3.0, 1)] and want[1] == [("a", 1.0, "repeated", 0), ("a", 5.0, "repeated", 1), ("zz", 0.0, "unknown", 0)]
    run = run_of(spark, tmp_path / "broken").open()
    own = {n: getattr(append, n) for n in ("write_rows", "write_rejects")}
    entry = runs.write_entry

    class Fault:
        def __enter__(self):
            def stop(*a, **k):
                raise RuntimeError("crash")

            def then_stop(f):
                return lambda *a, **k: (f(*a, **k), stop())

            if point == "before rejects":
                monkeypatch.setattr(append, "write_rejects", stop)
            elif point == "after rejects":
                monkeypatch.setattr(append, "write_rejects", then_stop(own["write_rejects"]))
            elif point == "after rows":
                monkeypatch.setattr(append, "write_rows", then_stop(own["write_rows"]))
            elif point == "half of the rows":
                monkeypatch.setattr(append, "write_rows", lambda rows, out, n: (own["write_rows"](rows.limit(1), out, n), stop()))
            else:
                monkeypatch.setattr(runs, "write_entry", then_stop(entry))

        def __exit__(self, *a):
            for n, f in own.items():
                monkeypatch.setattr(append, n, f)
            monkeypatch.setattr(runs, "write_entry", entry)

    if point == "before the commit":  # the batch was whole, but its commit is lost
        drive(run, str(tmp_path / "in2"))
        commits = str(tmp_path / "broken" / "easy" / "checkpoint" / "commits")
        for f in (*glob.glob(f"{commits}/1"), *glob.glob(f"{commits}/.1.crc")):
            os.remove(f)
        finish(run.start("easy", str(tmp_path / "in2")))
        assert state(run) == want
    else:
        assert drive(run, str(tmp_path / "in2"), Fault) == want


def test_strict_batches_stop_before_they_are_appended_and_again(spark, tmp_path):
    run, inbox = run_of(spark, tmp_path / "run").open(), str(tmp_path / "in")
    put(inbox, "0.json", [{"example_id": "a", "easy": 1.0}])
    finish(run.start("easy", inbox, strict=True))
    commits = str(tmp_path / "run" / "easy" / "checkpoint" / "commits")
    for f in (f"{commits}/0", f"{commits}/.0.crc"):
        os.remove(f)
    finish(run.start("easy", inbox, strict=True))  # its own record isn't repeated
    put(inbox, "1.json", [{"example_id": "b", "easy": 1.0}, {"example_id": "a", "easy": 1.0}])
    for _ in range(2):
        with pytest.raises(Exception, match="unknown_or_repeated"):
            finish(run.start("easy", inbox, strict=True))
        assert state(run)[:2] == ([("a", 1.0, 0)], [])


def test_a_replayed_batch_of_the_plain_sink_keeps_its_records(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put(inbox, "0.json", FILES[0])
    for strict in (False, False):
        finish(append.append_once(spark, inbox, EASY, dataset(spark), out, mark, strict=strict))
        for f in (f"{mark}/commits/0", f"{mark}/commits/.0.crc"):
            os.remove(f)
    assert [r.example_id for r in spark.read.parquet(out).collect()] == ["a"]
    assert sorted((r.example_id, r.reason) for r in spark.read.parquet(f"{out}_rejected").collect()) == [("a", "repeated"), ("zz", "unknown")]


def test_manifests_must_be_equal(spark, tmp_path):
    run = run_of(spark, tmp_path / "run").open()
    with pytest.raises(FileExistsError):
        run_of(spark, tmp_path / "run").open()
    run_of(spark, tmp_path / "run").open(resume=True)
    with pytest.raises(ValueError, match="differs in config"):
        run_of(spark, tmp_path / "run", config={"seed": 2}).open(resume=True)
    with pytest.raises(ValueError, match="dataset, records"):
        run_of(spark, tmp_path / "run", "abc").open(resume=True)
    with pytest.raises(ValueError, match="manifest"):
        run_of(spark, tmp_path / "none").open(resume=True)
    with pytest.raises(ValueError, match="isn't open"):
        run_of(spark, tmp_path / "none").start("easy", str(tmp_path))
    with pytest.raises(ValidationError, match="repeated"):
        run_of(spark, tmp_path / "other", "aab").open()
    assert run.saved()["records"] == 4


def test_phases_wait_and_agree(spark, tmp_path):
    run, easy, down = run_of(spark, tmp_path / "run").open(), str(tmp_path / "easy"), str(tmp_path / "down")
    put(easy, "0.json", [{"example_id": x, "easy": 1.0} for x in "abc"])
    put(down, "0.json", [{"example_id": "a", "easy": 1.0, "s": 0.5}])
    finish(run.start("easy", easy))
    with pytest.raises(ValidationError, match="isn't whole"):
        run.start("downstream", down)
    put(easy, "1.json", [{"example_id": "d", "easy": 1.0}])
    finish(run.start("easy", easy))
    finish(run.start("downstream", down))
    put(down, "1.json", [{"example_id": "b", "easy": 7.0, "s": 0.5}])
    with pytest.raises(Exception, match="differs_from_easy"):
        finish(run.start("downstream", down))
    put(down, "1.json", [{"example_id": x, "easy": 1.0, "s": 0.5} for x in "bcd"])
    with pytest.raises(ValidationError, match="isn't whole"):
        run.finish()
    with pytest.raises(ValidationError, match="isn't sealed"):
        run.verify()
    finish(run.start("downstream", down))
    sealed = run.finish()
    assert sealed == run.finish() == run_of(spark, tmp_path / "run").open(resume=True).verify() and sealed["phases"]["downstream"]["records"] == 4
    with pytest.raises(Exception, match="not what was sealed|isn't what was sealed|checksum"):
        run.records("easy").filter("example_id <> 'a'").drop("batch", "part").withColumn("part", F.lit(0)).write.mode("overwrite").partitionBy("part").parquet(str(tmp_path / "run" / "easy" / "rows" / "batch=9"))
        runs.write_entry(spark, str(tmp_path / "run" / "easy" / "ledger"), (9, 3, 0, "x"))
        run.verify()


def test_a_foreign_checkpoint_is_noticed(spark, tmp_path):
    run, inbox = run_of(spark, tmp_path / "run").open(), str(tmp_path / "in")
    put(inbox, "0.json", FILES[0])
    finish(run.start("easy", inbox))
    os.rename(str(tmp_path / "run" / "easy" / "checkpoint"), str(tmp_path / "lost"))
    put(inbox, "1.json", FILES[1])
    with pytest.raises(Exception, match="isn't this run's"):
        finish(run.start("easy", inbox))


@pytest.mark.parametrize("tail", [b'{"id":"c', b'{"id":"c"}', b"\xc3"])
def test_bytes_behind_the_last_line_end_are_a_tail(spark, tmp_path, tail):
    whole = b'{"id":"a"}\n\n{"id":"\xc3\xa9"}\n'
    (tmp_path / "cut.jsonl").write_bytes(whole + tail)
    (tmp_path / "whole.jsonl").write_bytes(whole)
    (tmp_path / "none.jsonl").write_bytes(b"")
    good, tails = records.recover_jsonl(spark, str(tmp_path), "id string")
    assert sorted(r.id for r in good.collect()) == ["a", "a", "é", "é"]
    got = tails.collect()
    assert [(r.path.rsplit("/", 1)[-1], r.offset, r.length, r.sha256, bytes(r.bytes)) for r in got] == [("cut.jsonl", len(whole), len(tail), hashlib.sha256(tail).hexdigest(), tail)]


def test_tails_of_files_of_many_splits(spark, tmp_path):
    lines = b"".join(b'{"id":"%d"}\n' % i for i in range(20_000))
    (tmp_path / "cut.jsonl").write_bytes(lines + b'{"id":"x" ')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        good, tails = records.recover_jsonl(spark, str(tmp_path / "cut.jsonl"), "id string")
        assert good.distinct().count() == good.count() == 20_000
        assert [(r.offset, r.value) for r in tails.collect()] == [(len(lines), '{"id":"x" ')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_bad_line_with_an_end_raises(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n{"id":\n{"id":"b"}\n')
    good, tails = records.recover_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string")
    assert tails.count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        good.collect()
