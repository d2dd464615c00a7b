"""Claims and gates with their conditions, cluster bootstraps and folded answers against plain computations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import text
from twinfold.operators import gates, predict, resample
from twinfold.operators.checks import ValidationError


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = rng.normal(), 5 + 3 * rng.normal()
        rows.append((i, f"g{i % 23}", i % 5, float(a), float(b), 2.0, int(rng.random() < 1 / (1 + np.exp(-a - 0.3 * (b - 5))))))
    return spark.createDataFrame(rows, "id long, grp string, fold int, a double, b double, same double, y int"), rows


def test_sets_and_folds_fitted_together_equal_separate_fits(table):
    df, rows = table
    sets = {"one": ["a"], "two": ["b", "a"], "flat": ["same", "b"]}
    got = {r.id: r for r in predict.scored(df, sets, "y", "fold", ["id"]).collect()}
    values = {n: np.array([r[k] for r in rows]) for k, n in enumerate(["id", "grp", "fold", "a", "b", "same", "y"])}
    for s, names in sets.items():
        x, y, fold = np.column_stack([values[n] for n in names]), values["y"], values["fold"]
        for t in range(5):
            train, test = fold != t, fold == t
            scale = np.where(x[train].std(axis=0) > 0, x[train].std(axis=0), 1.0)
            w = predict.fit_logistic((x[train] - x[train].mean(axis=0)) / scale, y[train])
            p = 1 / (1 + np.exp(-((x[test] - x[train].mean(axis=0)) / scale @ w[:-1] + w[-1])))
            assert [got[i][f"p_{s}"] for i in values["id"][test]] == pytest.approx(p.tolist(), rel=1e-7)


def test_null_features_and_one_class_folds_have_no_prediction(spark, table):
    df, _ = table
    holes = df.withColumn("a", F.when(F.col("id") > 3, F.col("a")))
    got = predict.cross_validated(holes, ["a", "b"], "y", "fold", ["id"]).filter("p is null")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3]
    flat = df.withColumn("y", (F.col("fold") == 1).cast("int"))
    assert {r.fold for r in predict.cross_validated(flat, ["a"], "y", "fold", ["id"]).filter("p is null").collect()} == {1}
    assert predict.cross_validated(df.limit(0), ["a"], "y", "fold", ["id"]).count() == 0


def test_claims_say_why_there_is_none(table):
    df, rows = table
    sets = {"base": ["a"], "more": ["a", "b"], "contemporaneous": ["b"]}
    ask = lambda d: predict.claim(d, sets, "base", "more", "y", "grp", ["id"]).collect()
    for few in (df.filter("grp in ('g1', 'g2', 'g3', 'g4')"), df.withColumn("y", F.lit(1)), df.limit(0)):
        found = ask(few)
        assert [(r.available, r.reason, r.model) for r in found] == [(False, predict.FEW, None)] and found[0].n == few.count()
    assert [(r.available, r.reason) for r in ask(df.withColumn("y", (F.col("grp") == "g7").cast("int")))] == [(False, predict.ONE_CLASS)]
    found = {r.model: r for r in ask(df)}
    assert set(found) == set(sets) and all(r.available and r.reason is None and r.n == 400 and r.events == sum(x[6] for x in rows) for r in found.values())
    assert found["more"].low <= found["more"].gain <= found["more"].high and found["base"].gain is None and 0 < found["more"].average_precision <= 1


NATURAL = "cell string, query int, prompt string, full int, right int, rank int, margin double, target int"


def natural(spark, rows, cells):
    expected = spark.createDataFrame(cells, "cell string, query int")
    return gates.natural_gate(spark.createDataFrame(rows, NATURAL), ["cell", "query"], expected, ["prompt"], target_rank="target")


def test_natural_gate_on_its_exact_cells(spark):
    rows = [("none", 0, "p1", 1, 1, 1, None, 1), ("none", 0, "p1", 1, 1, 1, None, 1), ("none", 0, "p2", 1, 1, 1, None, None), ("stale", 0, "p3", 1, 1, 1, 2.0, 1), ("stale", 1, "p3", 1, 1, 1, 2.0, 1), ("stale", 1, "p4", 0, 1, 3, -4.0, 2)]
    cells = [("none", 0), ("stale", 0), ("stale", 1)]
    got = {(r.cell, r.query): r for r in natural(spark, rows, cells).collect()}
    assert got["none", 0].passes and got["none", 0].prompts == 2 and got["none", 0].stale_margin is None and got["none", 0].mean_target_rank == 1
    assert got["stale", 0].passes and got["stale", 0].failed == []
    assert not got["stale", 1].passes and got["stale", 1].failed == ["full_ok", "rank_ok", "margin_ok"] and got["stale", 1].max_target_rank == 2
    for bad, why in (
        (rows[:3] + rows[4:], "missing_cells: 1"), ([*rows, ("more", 0, "p9", 1, 1, 1, None, 1)], "unexpected_cells: 1"), ([*rows, ("stale", 0, "p4", 1, 1, 1, 2.0, 1)], "constant: 1"),
        ([*rows, ("stale", 0, "p7", 2, 1, 1, 2.0, 1)], "accuracy_or_rank: 1"), ([*rows, ("stale", 0, "p7", 1, 1, 0, 2.0, 1)], "accuracy_or_rank: 1"), ([*rows, ("stale", 0, "p7", 1, 1, 1, float("nan"), 1)], "finite: 1"), ([], "not_empty"),
    ):
        with pytest.raises(ValidationError, match=why):
            natural(spark, bad, cells)


def test_cluster_bootstrap_equals_taking_whole_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [("x", f"c{k:02d}", float(v)) for k in range(17) for v in rng.normal(k, 1, rng.integers(1, 9))] + [("y", "only", 3.0), ("y", "only", 5.0)]
    got = {r.g: r for r in resample.cluster_interval(spark.createDataFrame(rows, "g string, c string, v double"), ["g"], "c", "v", 50, "s").collect()}
    members = [[v for g, c, v in rows if c == f"c{k:02d}"] for k in range(17)]
    number = lambda d, slot: int(hashlib.md5(f"s:{d}:{slot}".encode()).hexdigest()[:8], 16) % 17
    means = [np.mean(np.concatenate([members[number(d, slot)] for slot in range(17)])) for d in range(50)]
    assert (got["x"].low, got["x"].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), rel=1e-12)
    assert (got["x"].clusters, got["x"].n, got["x"].mean) == (17, len(rows) - 2, pytest.approx(np.mean([v for g, _, v in rows if g == "x"])))
    assert (got["y"].low, got["y"].high, got["y"].clusters) == (4.0, 4.0, 1)


def test_many_rows_are_drawn_in_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([("g", i, float(i * i % 31)) for i in range(60)], "g string, k int, v double")
    sent = sorted(map(tuple, resample.bootstrap_means(df, ["g"], ["k"], ["v"], 20, "s").collect()))
    monkeypatch.setattr(resample, "SENT", 0)
    monkeypatch.setattr(resample, "SLOTS", 100)
    assert sorted(map(tuple, resample.bootstrap_means(df, ["g"], ["k"], ["v"], 20, "s").collect())) == sent


def test_folded_answers(spark):
    words = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "Éa", "ıI", "İ", "ﬁn", "ŉ", "ǅ", "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.folded(F.col("w"))).collect()]
    assert got == [w.casefold() for w in words]
    rows = [(' "STRASSE!" ', "straße", "x", "correct"), ("Σ.", "a", "ς", "stale"), ("b", "a", None, "other"), (None, "a", "b", "other")]
    frame = spark.createDataFrame(rows, "t string, c string, s string, want string")
    assert all(r.want == r.got for r in frame.select("want", text.answer_class(F.col("t"), F.col("c"), F.col("s")).alias("got")).collect())
