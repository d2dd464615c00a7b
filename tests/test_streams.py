"""numpy's index draws made in blocks, against numpy's own."""

import numpy as np
import pytest

from twinfold.operators import resample, streams
from twinfold.operators.checks import ValidationError


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097, 1 << 20, (1 << 31) + 1, 3_000_000_019])
def test_blocks_are_the_stream(n):
    got = np.concatenate([streams.taken(k, n, 81004) for k in range(2)])
    rng = np.random.default_rng(81004)
    want = np.concatenate([rng.integers(n, size=k) for k in (7, 5001, len(got) - 5008)])  # the stream goes on over calls
    assert (got == want).all()


def test_draws_in_many_blocks_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(streams, "BLOCK", 64)
    monkeypatch.setattr(streams, "SLICE", 10)
    bits, whole = 64, streams.taken

    def small(block, n, seed):  # tasks unpickle the module's own BLOCK
        raw = np.random.PCG64(seed)
        raw.advance(block * (bits // 2))
        r = raw.random_raw(bits // 2)
        wide = np.stack([r & np.uint64(0xFFFFFFFF), r >> np.uint64(32)], axis=1).ravel() * np.uint64(n)
        return (wide[(wide & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)] >> np.uint64(32)).astype(np.int64)

    assert (small(1, 7, 3) == whole(1, 7, 3)).all()
    sizes = spark.createDataFrame([("a", 1), ("b", 7), ("c", 150)], "g string, n long")
    monkeypatch.setattr(streams, "taken", small)
    got = {}
    for r in streams.index_draws(sizes, ["g"], 9, 3).collect():
        got.setdefault((r.g, r.draw), []).append(r.i)
    for g, n in (("a", 1), ("b", 7), ("c", 150)):
        want = np.random.default_rng(3).integers(n, size=(9, n))
        assert all(sorted(got[g, d]) == sorted(want[d]) for d in range(9))
    assert len(got) == 27


@pytest.mark.parametrize("sent", [0, 100_000])
def test_intervals_equal_one_generator(spark, monkeypatch, sent):
    monkeypatch.setattr(streams, "SENT", sent)  # both ways give the same
    rng = np.random.default_rng(0)
    x = {g: rng.normal(size=n) for g, n in (("a", 40), ("b", 1), ("c", 700))}
    rows = [(g, i, float(v)) for g, vs in x.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    got = {r.g: r for r in streams.exact_intervals(df, ["g"], ["i"], "v", 2000, 81004, 0.975).collect()}
    for g, v in x.items():
        want = resample.exact_interval(v, 2000, 81004, 0.975)
        assert (got[g].n, got[g].mean, got[g].low, got[g].high) == pytest.approx((len(v), want["mean"], want["low"], want["high"]), rel=1e-9)
    assert streams.exact_intervals(df.limit(0), ["g"], ["i"], "v").count() == 0
    with pytest.raises(ValidationError, match="finite"):
        streams.exact_intervals(spark.createDataFrame([("a", 1, float("nan"))], df.schema), ["g"], ["i"], "v")


def test_registered_queries_equal_one_generator(spark, tiny):
    import __spark_entry__ as entry
    from twinfold.plans import base

    pairs = [r for r in base.pairs(spark, tiny).collect() if r.effect is not None]
    for r in entry.queries()["summary_exact"](spark, tiny).collect():
        x = np.array([p.effect for p in sorted(pairs, key=lambda p: p.history) if p.condition == r.condition])
        want = resample.exact_summary(x)
        assert all(getattr(r, k) == pytest.approx(v, rel=1e-9) for k, v in want.items())
    assert entry.queries()["bootstrap_mean_exact"](spark, tiny).count() > 0


def test_values_meet_their_blocks_in_parts(spark, monkeypatch):
    """Groups of more values than a task holds, and copies of values that share the blocks; drawn indices are never rows."""
    for name, v in (("SENT", 0), ("HELD", 256), ("BLOCK", 1 << 12), ("RUN", 2), ("COPIES", 3)):
        monkeypatch.setattr(streams, name, v)
    monkeypatch.setattr(streams, "index_draws", None)
    rng = np.random.default_rng(1)
    x = {g: rng.normal(size=n) for g, n in (("a", 40), ("b", 256), ("c", 700))}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in x.items() for i, v in enumerate(vs)], "g string, i int, v double").repartition(5)
    got = {(r.g, r.draw): r.v for r in streams.exact_means(df, ["g"], ["i"], ["v"], 30, 5).collect()}
    for g, v in x.items():
        assert [got[g, d] for d in range(30)] == pytest.approx(list(resample.index_means(v, 30, 5)), rel=1e-9)
