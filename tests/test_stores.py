"""Canonical digests in the JVM, discovery by content, checksums, orders averaged first and the perfect gate, on rows made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from twinfold.functions import digests
from twinfold.operators import contrasts, gates, lineage
from twinfold.operators.checks import ValidationError
from twinfold.sources import records

TEXTS = ["", "plain", 'q"\\/b', "a\nb\r\t\b\f", "\x00\x01\x1f\x7f", "Straße 北京 é", "\U0001f600 x \U0001f600\U00010000", " ﻿", "x" * 200_000 + "é"]


def test_canonical_digest_equals_hashlib(spark):
    kind = "z string, a long, m map<string,array<int>>, b boolean, s struct<y:string,k:struct<n:smallint>>, `ké\"y` string"
    rows = [(t, i - 4, {t[:3]: [i, None], "b": [], "a": None}, i % 2 == 0, (t[::-1][:9], (i,)), t[:1]) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = df.select(digests.canonical_digest(df, df.columns).alias("d")).collect()
    plain = lambda r: {"z": r[0], "a": r[1], "m": r[2], "b": r[3], "s": r[4] and {"y": r[4][0], "k": {"n": r[4][1][0]}}, 'ké"y': r[5]}
    assert [r.d for r in got] == [digests.canonical(plain(r)) for r in rows]


def test_canonical_text_of_documents_is_what_python_writes(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    for r in df.select("text", digests.json_string(F.col("text")).alias("j")).collect():
        assert r.j == (None if r.text is None else json.dumps(r.text))


def test_canonical_text_refuses_floating_numbers(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    with pytest.raises(TypeError, match="double"):
        digests.canonical_digest(df, ["x"])


def test_discovery_opens_the_first_record(spark, tmp_path):
    deep = tmp_path / "runs" / "deep"
    deep.mkdir(parents=True)
    (tmp_path / "a_dev.jsonl").write_text('\n  \n{"stage":"v1","id":"a"}\n{"stage":"v2","id":"b"}\n')
    (deep / "b_gate.jsonl").write_text('{"stage":"v2","id":"c"}\n')
    (deep / "c_gate.json").write_text(json.dumps({"rows": [{"stage": "v1", "id": "d"}, {"stage": "v3", "id": "e"}]}, indent=1))
    (deep / "empty_gate.jsonl").write_text("\n")
    (deep / "none_gate.json").write_text('{"rows": []}')
    (deep / "gate_scores.jsonl").write_text("not json\n")
    (deep / "other.jsonl").write_text("nor this\n")
    found = records.first_records(spark, str(tmp_path), "stage string, id string", ["_dev", "gate"], ["scores"])
    assert sorted((r.path.rsplit("/", 1)[1], r.stage, r.id) for r in found.collect()) == [
        ("a_dev.jsonl", "v1", "a"), ("b_gate.jsonl", "v2", "c"), ("c_gate.json", "v1", "d"), ("empty_gate.jsonl", None, None), ("none_gate.json", None, None),
    ]
    assert found.filter("stage = 'v1'").count() == 2
    (deep / "bad_gate.jsonl").write_text('{"stage":\n')
    with pytest.raises(Exception, match="MALFORMED"):
        records.first_records(spark, str(tmp_path), "stage string, id string", ["_dev", "gate"], ["scores"]).collect()


def test_discovery_without_files(spark, tmp_path):
    assert records.first_records(spark, str(tmp_path), "id string", ["gate"]).count() == 0


def test_csv_keeps_values_and_refuses_other_headers(spark, tmp_path):
    out = str(tmp_path / "x.csv")
    rows = [("a,b", 0.1, 1), ('q"', -1e300, None), (None, 5e-324, 3)]
    df = spark.createDataFrame(rows, "name string, x double, n int")
    records.write_csv(df, out)
    assert sorted(records.read_by_suffix(spark, out, df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(Exception, match="exist"):
        records.write_csv(df, out)
    with pytest.raises(Exception, match="(?i)header|CSV"):
        records.read_csv(spark, out, "other string, x double, n int").collect()


def test_checksums_find_every_change(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "")], "k string, n int, t string")
    stored = lineage.with_checksum(df)
    assert lineage.bad_checksums(stored).isEmpty()
    for column, value in (("k", "'z'"), ("n", "n + 1"), ("t", "coalesce(t, '') || ' '"), ("record_sha256", "null")):
        assert lineage.bad_checksums(stored.withColumn(column, F.expr(value))).count() == 3


def test_orders_are_averaged_before_the_contrast(spark):
    rows = [("h", "a", 0, 1.0), ("h", "a", 0, 3.0), ("h", "a", 0, 5.0), ("h", "a", 1, 11.0), ("h", "r", 0, 2.0), ("h", "r", 1, 4.0), ("i", "a", 0, 7.0), ("i", "r", 0, 1.0), ("i", "r", 1, None)]
    df = spark.createDataFrame(rows, "history string, condition string, o int, e double")
    got = {(r.history, r.condition): r.e for r in contrasts.averaged_orders(df, ["history", "condition"], ["o"], 2, "e").collect()}
    assert got == {("h", "a"): 7.0, ("h", "r"): 3.0, ("i", "a"): None, ("i", "r"): None}


def gate(spark, rows, least=1.0):
    df = spark.createDataFrame(rows, "variant string, cell int, ok int, rank int, aligned boolean")
    expected = spark.createDataFrame([(1,), (None,)], "cell int")
    return {r.variant: r.asDict() for r in gates.perfect_gate(df, "variant", ["cell"], expected, ["ok"], ["rank"], "aligned", least).collect()}


def test_perfect_gate_on_planted_faults(spark):
    whole = lambda v: [(v, 1, 1, 1, True), (v, 1, 1, 1, True), (v, None, 1, 1, True)]
    rows = whole("good") + whole("miss")[1:] + [("miss", 1, 0, 1, True)] + whole("rank") + [("rank", None, 1, 2, True)] + whole("mute") + [("mute", 1, 1, 1, None)]
    rows += whole("lone")[:2] + whole("more") + [("more", 9, 1, 1, True)] + whole("void") + [("void", 1, None, 1, True)]
    got = gate(spark, rows)
    assert [v for v in got if got[v]["passes"]] == ["good"]
    assert (got["miss"]["failed_cells"], got["rank"]["failed_cells"], got["mute"]["aligned"], got["lone"]["missing_cells"], got["more"]["unexpected_cells"], got["void"]["failed_cells"]) == (1, 1, False, 1, 1, 1)
    assert gate(spark, rows, 0.5)["miss"]["passes"] and not gate(spark, rows, 0.5)["rank"]["passes"]


def test_perfect_gate_refuses_what_is_no_accuracy(spark):
    with pytest.raises(ValidationError, match="ok_is_0_or_1"):
        gate(spark, [("a", 1, 2, 1, True)])
    with pytest.raises(ValidationError, match="not_empty"):
        gate(spark, [])
