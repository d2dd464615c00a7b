"""Resampling over histories.

Portable forms draw by md5 in plain column expressions: draw d's slot i takes the row numbered md5(seed:d:i) mod n, so any SQL engine can
repeat them. Rows are numbered once, by sums over buckets of their order; draws x n slots are generated from a group's size and joined on the
number, then averaged with map-side aggregation. Exact forms repeat numpy's streams, which one generator fills in order: their input is one
number per history (8 bytes), a group in one Arrow task, in a stated order that is part of the result. Their draws run in chunks of
bounded memory. For groups that one task can't hold, use the portable forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import sums_before, with_range
from .pinning import pinned

CHUNK = 1 << 22  # numbers drawn at once
SENT = 100_000  # rows (a group's key and a few numbers each, some MB) that are sent to every task at most
SLOTS = 250_000  # slots of a task, about
TASKS = 2_000  # tasks that make slots, at most


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with i (0 and up within the group, by `order`) and n, the group's rows. Ranks are sums over ranges of the order, so no task holds a group."""
    placed = with_range(df, group, order[0], "__place")
    ranked = sums_before(placed, group, F.col("__place"), [F.col(c) for c in order], {"i": F.lit(1).cast("long")}).drop("__place")
    sizes = placed.groupBy(*group).agg(F.count("*").alias("n"))
    return ranked.join(sizes, list(group)) if group else ranked.crossJoin(F.broadcast(sizes))


def md5_number(*parts: Column) -> Column:
    """First 32 bits of an md5 over parts joined by colons, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def draws(df: DataFrame, group: Sequence[str], n_draws: int, seed: str) -> DataFrame:
    """(group, draw, i): the rows that each draw takes, with replacement."""
    return _slots(df.groupBy(*group).agg(F.count("*").alias("n")), group, n_draws, seed)


def _slots(sizes: DataFrame, group: Sequence[str], n_draws: int, seed: str, parts: int = 1) -> DataFrame:
    """As draws, of (group, n); runs of SLOTS slots of a draw are dealt to `parts` tasks before the slots are made, so no row lists a group's."""
    each = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS))))
    each = each.repartition(parts, "draw", "__run") if parts > 1 else each
    slots = each.withColumn("slot", F.explode(F.sequence(F.col("__run") * SLOTS, F.least(F.col("n"), (F.col("__run") + 1) * SLOTS) - 1)))
    return slots.select(*group, "draw", F.pmod(md5_number(F.lit(seed), F.col("draw"), F.col("slot")), F.col("n")).alias("i"))


def bootstrap_means(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], n_draws: int, seed: str) -> DataFrame:
    """(group, draw, mean of each value) of paired draws: one set of indices for all values.

    The numbered rows are pinned and counted; up to SENT of them are sent to the tasks that make the slots, so these are summed by draw where
    they are made. More rows meet their slots in a shuffle: Spark knows slots by the size they have before they are made, and would send them all.
    """
    rows = pinned(numbered(df.select(*group, *order, *values), group, order).select(*group, "i", "n", *values))
    count = rows.count()
    slots = _slots(rows.filter("i = 0").select(*group, "n"), group, n_draws, seed, min(TASKS, 1 + count * n_draws // SLOTS))
    found = rows.drop("n").hint("broadcast" if count <= SENT else "merge")
    return slots.join(found, [*group, "i"]).groupBy(*group, "draw").agg(*(F.avg(v).alias(v) for v in values))


def bootstrap_interval(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n_draws: int = 200, seed: str = "81004", level: float = 0.95) -> DataFrame:
    """(group, mean, low, high): linear quantiles of the draws' means at (1 -+ level) / 2."""
    means = bootstrap_means(df, group, order, [value], n_draws, seed)
    ends = means.groupBy(*group).agg(F.percentile(value, (1 - level) / 2).alias("low"), F.percentile(value, (1 + level) / 2).alias("high"))
    return df.groupBy(*group).agg(F.avg(value).alias("mean")).join(ends, list(group))


def ratio_interval(df: DataFrame, group: Sequence[str], order: Sequence[str], numerator: str, denominator: str, n_draws: int = 200, seed: str = "73021") -> DataFrame:
    """Ratio of means with a paired bootstrap; usable only if the denominator's lower bound and each of its draws exceed 1."""
    means = bootstrap_means(df, group, order, [numerator, denominator], n_draws, seed).withColumn("ratio", F.col(numerator) / F.col(denominator))
    ends = means.groupBy(*group).agg(F.percentile("ratio", 0.025).alias("low"), F.percentile("ratio", 0.975).alias("high"), ((F.percentile(denominator, 0.025) > 1) & (F.min(denominator) > 1)).alias("usable"))
    return df.groupBy(*group).agg((F.avg(numerator) / F.avg(denominator)).alias("ratio")).join(ends, list(group))


def cluster_interval(df: DataFrame, group: Sequence[str], cluster: str, value: str, n_draws: int = 200, seed: str = "cluster", level: float = 0.95) -> DataFrame:
    """(group, clusters, n, mean, low, high) over all rows of the clusters that each draw takes, as many as there are, with replacement.

    A draw's mean is the sum of its clusters' sums by the sum of their counts, so clusters may differ in size and only (sum, count) of each
    is drawn. Null values are left out; a cluster of nulls alone counts as one without rows.
    """
    per = pinned(df.groupBy(*group, cluster).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("__sum"), F.count(value).alias("__count")))
    means = bootstrap_means(per, group, [cluster], ["__sum", "__count"], n_draws, seed).withColumn("m", F.try_divide("__sum", "__count"))
    ends = means.groupBy(*group).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    facts = per.groupBy(*group).agg(F.count("*").alias("clusters"), F.sum("__count").alias("n"), F.try_divide(F.sum("__sum"), F.sum("__count")).alias("mean"))
    return facts.join(ends, list(group)) if group else facts.crossJoin(F.broadcast(ends))


def sign_flip(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n_draws: int = 200, seed: str = "flip") -> DataFrame:
    """(group, observed, p): p = (#{|mean| >= |observed|} + 1) / (draws + 1) under random signs of the histories."""
    rows = numbered(df, group, order)
    flipped = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("x", F.col(value) * F.when(md5_number(F.lit(seed), F.col("draw"), F.col("i")) % 2 == 0, 1).otherwise(-1))
    means = flipped.groupBy(*group, "draw").agg(F.round(F.avg("x"), 9).alias("m"))
    seen = df.groupBy(*group).agg(F.round(F.avg(value), 9).alias("observed"))
    return means.join(seen, list(group)).groupBy(*group).agg(F.any_value("observed").alias("observed"), ((F.count_if(F.abs("m") >= F.abs("observed")) + 1) / F.lit(float(n_draws + 1))).alias("p"))


def two_sample_interval(df: DataFrame, side: str, sides: tuple, order: Sequence[str], value: str, n_draws: int = 200, seed: str = "two") -> DataFrame:
    """Difference of two independent samples' means, each side drawn by itself."""
    means = bootstrap_means(df, [side], order, [value], n_draws, seed)
    a, b = (F.max(F.when(F.col(side) == s, F.col(value))) for s in sides)
    ends = means.groupBy("draw").agg((a - b).alias("d")).agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    first, second = (F.avg(F.when(F.col(side) == s, F.col(value))) for s in sides)
    return df.agg((first - second).alias("difference")).crossJoin(F.broadcast(ends))


# ---- exact numpy streams


def _blocks(n_draws: int, n: int) -> Iterator[int]:
    step = max(1, CHUNK // max(1, n))
    for lo in range(0, n_draws, step):
        yield min(step, n_draws - lo)


def index_means(x: np.ndarray, n_draws: int, seed: int) -> np.ndarray:
    """Means of integer-index draws; chunks continue one stream."""
    rng, n = np.random.default_rng(seed), len(x)
    return np.concatenate([x[rng.integers(n, size=(k, n))].mean(axis=1) for k in _blocks(n_draws, n)])


def exact_interval(x: np.ndarray, n_draws: int = 2000, seed: int = 81004, level: float = 0.95) -> dict[str, float]:
    """Index bootstrap; raises on empty or non-finite input."""
    x = np.asarray(x, dtype=float)
    if x.ndim != 1 or not len(x) or not np.isfinite(x).all():
        raise ValueError("a non-empty list of finite numbers is needed")
    low, high = np.quantile(index_means(x, n_draws, seed), [(1 - level) / 2, (1 + level) / 2])
    return {"n": len(x), "mean": float(x.mean()), "low": float(low), "high": float(high)}


def exact_summary(x: np.ndarray, n_draws: int = 2000, seed: int = 73021) -> dict[str, float | None]:
    """As exact_interval at 95 %, with median, trimmed mean and fraction positive; nulls on empty input."""
    x = np.asarray(x, dtype=float)
    names = ("mean", "median", "trimmed", "fraction_positive", "low", "high")
    if not len(x):
        return {"n": 0} | dict.fromkeys(names)
    k, s = int(0.1 * len(x)), np.sort(x)
    low, high = np.quantile(index_means(x, n_draws, seed), [0.025, 0.975])
    values = (x.mean(), np.median(x), s[k : len(s) - k].mean(), (x > 0).mean(), low, high)
    return {"n": len(x)} | {a: float(b) for a, b in zip(names, values, strict=True)}


def exact_cluster(x: np.ndarray, groups: np.ndarray, n_draws: int = 2000, seed: int = 0) -> dict[str, float]:
    """Cluster bootstrap: each draw takes sorted groups with replacement and averages all their rows."""
    rng, names = np.random.default_rng(seed), np.unique(groups)
    members = {g: x[groups == g] for g in names}
    means = [np.concatenate([members[g] for g in rng.choice(names, len(names))]).mean() for _ in range(n_draws)]
    low, high = np.quantile(means, [0.025, 0.975])
    return {"n": len(names), "mean": float(x.mean()), "low": float(low), "high": float(high)}


def exact_permutation(x: np.ndarray, n_draws: int = 10_000, seed: int = 0) -> dict[str, float]:
    """Choice bootstrap, then sign flips from the same generator; non-finite values raise."""
    x = np.asarray(x, dtype=float)
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("a non-empty list of finite numbers is needed")
    rng, n = np.random.default_rng(seed), len(x)
    boot = np.concatenate([rng.choice(x, (k, n)).mean(axis=1) for k in _blocks(n_draws, n)])
    flips = np.concatenate([(x * rng.choice([-1, 1], (k, n))).mean(axis=1) for k in _blocks(n_draws, n)])
    low, high = np.quantile(boot, [0.025, 0.975])
    return {"n": n, "mean": float(x.mean()), "low": float(low), "high": float(high), "p": float(((np.abs(flips) >= abs(x.mean())).sum() + 1) / (n_draws + 1))}


def exact_two_sample(a: np.ndarray, b: np.ndarray, n_draws: int = 2000, seed: int = 73021) -> dict[str, float]:
    """Difference of means: all draws of a, then all of b, from one generator."""
    rng = np.random.default_rng(seed)
    means = [np.concatenate([x[rng.integers(len(x), size=(k, len(x)))].mean(axis=1) for k in _blocks(n_draws, len(x))]) for x in (np.asarray(a, float), np.asarray(b, float))]
    low, high = np.quantile(means[0] - means[1], [0.025, 0.975])
    return {"difference": float(np.mean(a) - np.mean(b)), "low": float(low), "high": float(high)}


def derived_seed(seed: int, layer: int, role: int, step: int = 31) -> int:
    """Seeds that reports derive from a layer and a role's number."""
    return seed + layer * step + role


def by_group(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, statistic: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """An exact statistic of each group's values in the stated order; a group is one number per history."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(list(order), kind="stable")[value].to_numpy(float)
        return pd.DataFrame([dict(zip(group, key, strict=True)) | statistic(x)])

    return df.select(*group, *order, value).groupBy(*group).applyInPandas(run, schema)


def shared_stream(df: DataFrame, group: str, order: Sequence[str], value: str, n_draws: int = 2000, seed: int = 0) -> DataFrame:
    """Intervals of all groups from one generator that passes through them in sorted order; df is a small summary of histories."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        for name, part in rows.groupby(group, sort=True):
            x = part.sort_values(list(order), kind="stable")[value].to_numpy(float)
            low, high = np.quantile(rng.choice(x, (n_draws, len(x))).mean(axis=1), [0.025, 0.975])
            out.append((name, float(x.mean()), float(low), float(high)))
        return pd.DataFrame(out, columns=[group, "mean", "low", "high"])

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, *order, value, F.lit(0).alias("__one")).groupBy("__one").applyInPandas(run, f"{group} {kind}, mean double, low double, high double")
