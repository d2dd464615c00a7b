"""Probes fitted together against plain fits one by one, and their defined results at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.operators import probes
from twinfold.operators.checks import ValidationError


def plain_fit(x, y, k, strength):
    """Weights of standardised features by Newton's method on the whole Hessian, one model alone; gives a function from rows to probabilities."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    a = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, h = np.zeros((k, a.shape[1])), a.shape[1]
    ridge = np.diag(([(2 if k == 2 else 1) / strength] * (h - 1) + [1e-9]) * k)

    def p_of(b, w):
        z = b @ w.T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(60):
        p = p_of(a, w)
        slope = ((p - np.eye(k)[y]).T @ a).ravel() + ridge @ w.ravel()
        curve = ridge + np.block([[(a * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a for j in range(k)] for i in range(k)])
        w = w - np.linalg.solve(curve, slope).reshape(w.shape)
    return lambda rows: p_of(np.hstack([(rows - mean) / sd, np.ones((len(rows), 1))]), w)


def made(k, n=180, width=4, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(k, size=n)
    x = rng.normal(size=(n, width)) + 1000.0
    x[np.arange(n), y] += 1.2
    x[:, -1] = 7.0  # no deviation
    return x, y


@pytest.mark.parametrize("k", [2, 3])
def test_grouped_probes_equal_single_fits(spark, k):
    x, y = made(k)
    history = np.arange(len(y)) % 12
    rows = [("q", lay, i, f"h{history[i]:02}", "abc"[y[i]], [float(v) for v in (x[i] if lay else x[i] * x[i])]) for i in range(len(y)) for lay in (0, 1)]
    df = spark.createDataFrame(rows, "query string, layer int, id int, h string, y string, v array<double>")
    got = {r.layer: r for r in probes.grouped_probes(df, ["query", "layer"], [("q", 0), ("q", 1)], "v", "y", "h", key="id").collect()}
    again = {r.layer: r for r in probes.grouped_probes(df.repartition(7, "v"), ["query", "layer"], [("q", 0), ("q", 1)], "v", "y", "h", key="id").collect()}
    folds = {r.h: r.fold for r in probes.grouped_folds(df, "h", 5).collect()}
    fold = np.array([folds[f"h{h:02}"] for h in history])
    for lay, r in got.items():
        z, p = (x if lay else x * x), np.zeros((len(y), k))
        for f in range(5):
            p[fold == f] = plain_fit(z[fold != f], y[fold != f], k, 1.0)(z[fold == f])
        hit, loss = p.argmax(axis=1) == y, -np.log(p[np.arange(len(y)), y])
        assert (r.n, r.accuracy) == (len(y), pytest.approx(hit.mean()))
        assert r.log_loss == pytest.approx(loss.mean(), abs=2e-5)
        assert r.balanced_accuracy == pytest.approx(np.mean([hit[y == c].mean() for c in range(k)]))
        assert [(q.fold, q.n, round(q.accuracy, 9)) for q in r.folds] == [(f, (fold == f).sum(), round(hit[fold == f].mean(), 9)) for f in range(5)]
        assert r.low <= r.accuracy <= r.high and r.high - r.low < 0.25
        assert (again[lay].accuracy, again[lay].low, again[lay].high) == (r.accuracy, r.low, r.high)


def test_curve_equals_single_fits(spark):
    x, y = made(3)
    split = np.array(["train", "train", "validation", "test", "other"])[np.arange(len(y)) % 5]
    rows = [(i, lay, split[i], int(y[i]), [float(v) for v in (x[i] * 0 + i if lay == 2 else x[i])]) for i in range(len(y)) for lay in (0, 2)]
    df = spark.createDataFrame(rows, "id int, layer int, split string, y int, v array<float>")
    got = {r.layer: r for r in probes.probe_curve(df, "layer", [0, 1, 2], "v", "y", "split", (0.01, 1.0, 10.0), key="id").collect()}
    x = x.astype(np.float32).astype(float)
    part = {s: split == s for s in ("train", "validation", "test")}
    fits = {c: plain_fit(x[part["train"]], y[part["train"]], 3, c) for c in (0.01, 1.0, 10.0)}
    score = lambda c, s: (fits[c](x[part[s]]).argmax(axis=1) == y[part[s]]).mean()
    best = max((0.01, 1.0, 10.0), key=lambda c: score(c, "validation"))
    r = got[0]
    assert (r.strength, r.chance, r.n_train) == (best, pytest.approx(1 / 3), part["train"].sum())
    assert [r.train_accuracy, r.validation_accuracy, r.accuracy] == pytest.approx([score(best, s) for s in ("train", "validation", "test")])
    assert r.majority == pytest.approx(np.bincount(y[part["train"]]).max() / part["train"].sum()) and r.shuffled < r.accuracy
    assert got[1].n_train == 0 and got[1].strength is None and got[1].accuracy is None


def test_curve_at_its_edges(spark):
    kind = "id int, split string, y string, v array<double>"
    one = spark.createDataFrame([(i, "train", "a", [float(i)]) for i in range(4)], kind)
    assert probes.probe_layer(one, "v", "y", "split", key="id") == {"strength": None, "accuracy": None, "shuffled": None, "chance": None, "majority": None, "train_accuracy": None, "validation_accuracy": None, "n_train": 4}
    assert probes.probe_layer(one.limit(0), "v", "y", "split", key="id")["n_train"] == 0
    rows = [(i, "train", "ab"[i % 2], [i % 2 * 4.0 + i / 10]) for i in range(8)] + [(9, "test", "c", [0.0]), (10, "test", "a", [0.0])]
    found = probes.probe_layer(spark.createDataFrame(rows, kind), "v", "y", "split", key="id")
    assert (found["strength"], found["accuracy"], found["validation_accuracy"], found["train_accuracy"]) == (0.01, 0.5, None, 1.0)  # a label that no fit saw is missed


@pytest.mark.parametrize("bad", [("b", None), (None, [1.0]), ("b", [1.0, 2.0]), ("b", [float("nan")]), ("b", [None])])
def test_probes_refuse_odd_rows(spark, bad):
    rows = [(i, "train", "ab"[i % 2], [float(i)]) for i in range(8)] + [(8, "train", *bad)]
    with pytest.raises(ValidationError, match="finite"):
        probes.probe_layer(spark.createDataFrame(rows, "id int, split string, y string, v array<double>"), "v", "y", "split", key="id")


def test_grouped_probes_refuse_one_label(spark):
    df = spark.createDataFrame([("q", i, f"h{i}", "a", [float(i)]) for i in range(10)], "query string, id int, h string, y string, v array<double>")
    with pytest.raises(ValidationError, match="too few"):
        probes.grouped_probes(df, ["query"], [("q",)], "v", "y", "h")


def test_minimiser_finds_each_minimum():
    rng = np.random.default_rng(3)
    goals = {i: rng.normal(size=6) * 10**i for i in range(3)}
    curves = {i: np.diag(10.0 ** rng.uniform(-2, 2, 6)) for i in goals}
    calls = []

    def evaluate(at):
        calls.append(len(at))
        return {i: ((x - goals[i]) @ curves[i] @ (x - goals[i]) / 2, curves[i] @ (x - goals[i])) for i, x in at.items()}

    found = probes.minimised(evaluate, {i: np.zeros(6) for i in goals}, 1e-8)
    assert all(np.allclose(found[i], goals[i], atol=1e-5) for i in goals) and calls[0] == 3 and calls[-1] < 3
    assert probes.minimised(evaluate, {}) == {}


def test_permutations_differ_by_layer(spark):
    df = spark.createDataFrame([(str(i), k, i % 5) for i in range(60) for k in (0, 1)], "__id string, k int, label int")
    got = probes.permuted(df, 1, ["k"]).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("__id", "label"))).alias("r")).collect()
    a, b = ([x.label for x in r.r] for r in got)
    assert sorted(a) == sorted(b) and a != b
