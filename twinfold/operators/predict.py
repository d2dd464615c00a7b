"""Grouped cross-validated prediction: folds by group, ridge logistic fits, and metrics by ranks and sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import sums_before, with_range
from .pinning import pinned
from .resample import bootstrap_interval


def greedy_folds(sizes: dict, k: int) -> dict:
    """Group -> fold: largest group first, each to the lightest fold (ties: later-sorted group first, lower fold)."""
    load, out = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (sizes[g], g), reverse=True):
        fold = load.index(min(load))
        out[g] = fold
        load[fold] += sizes[g]
    return out


def hashed_fold(group: Column, k: int, seed: str) -> Column:
    """A group's fold by md5: the same in any engine, without looking at the other groups."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), group.cast("string"))), 1, 8), 16, 10).cast("long") % k).cast("int")


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights (intercept last, unpenalised) minimising sum log loss + |w|^2 / (2 c), by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([1 / c] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-12 * np.eye(len(w)), a.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def summed(rows: DataFrame, run: Callable[[pa.RecordBatch], np.ndarray], length: int) -> np.ndarray:
    """The sum over all rows of a vector that run gives for each Arrow batch: one vector a task, added up by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                total += run(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], ["pos", "value"])

    found = rows.mapInArrow(task, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).toArrow()  # `length` rows
    out = np.zeros(length)
    out[found["pos"].to_numpy()] = found["value"].to_numpy()
    return out


def _sums(rows: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """summed, for run(features, outcome, fold) of a batch's columns."""

    def each(b: pa.RecordBatch) -> np.ndarray:
        columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]
        return run(np.column_stack(columns[2:]), columns[0], columns[1].astype(int))

    return summed(rows, each, length)


def fitted(rows: DataFrame, sets: Mapping[str, Sequence[str]], k: int, c: float = 1.0, steps: int = 25) -> dict[tuple[str, int], np.ndarray | None]:
    """(set, fold) -> weights of the set's features, intercept last, of a ridge logistic model (see fit_logistic) of the other folds' rows.

    rows: columns __y, __fold and the features of all sets, pinned; rows with a null are left out. All folds and sets are fitted together: a
    Newton step is one scan, in which each task adds up gradients and curvatures in numpy and gives one vector, and only the summed
    vector reaches the driver. A model whose training rows have one class is None.
    """
    names = list(dict.fromkeys(x for features in sets.values() for x in features))
    rows = rows.select("__y", "__fold", *names).dropna()
    d = len(names)

    def powers(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        each = np.column_stack([np.ones(len(y)), y, x])
        return np.stack([each[fold == t].sum(axis=0) for t in range(k)]).ravel()

    first = _sums(rows, powers, k * (d + 2)).reshape(k, d + 2)
    others = first.sum(axis=0) - first
    usable = [t for t in range(k) if 0 < others[t, 1] < others[t, 0]]
    found: dict[tuple[str, int], np.ndarray | None] = {(s, t): None for s in sets for t in range(k)}
    if not usable or not first[:, 0].sum():
        return found
    centre = first[:, 2:].sum(axis=0) / first[:, 0].sum()
    squares = _sums(rows, lambda x, y, fold: np.stack([((x - centre)[fold == t] ** 2).sum(axis=0) for t in range(k)]).ravel(), k * d).reshape(k, d)
    mean = others[:, 2:] / np.maximum(others[:, :1], 1) - centre
    scale = np.sqrt(np.maximum(0.0, (squares.sum(axis=0) - squares) / np.maximum(others[:, :1], 1) - mean**2))
    scale = np.where(scale > 1e-12 * (1 + np.abs(mean)), scale, 1.0)
    at = {s: [names.index(x) for x in features] for s, features in sets.items()}
    models = [(s, t) for s in sets for t in usable]
    weight = {m: np.zeros(len(at[m[0]]) + 1) for m in models}
    starts = np.cumsum([0] + [len(weight[m]) * (len(weight[m]) + 1) for m in models])

    def slopes(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        parts = []
        for s, t in models:
            rest = fold != t
            a = np.column_stack([(x[rest][:, at[s]] - centre[at[s]] - mean[t, at[s]]) / scale[t, at[s]], np.ones(rest.sum())])
            p = 1 / (1 + np.exp(-np.clip(a @ weight[s, t], -35, 35)))
            parts += [a.T @ (p - y[rest]), ((a * (p * (1 - p))[:, None]).T @ a).ravel()]
        return np.concatenate(parts)

    for _ in range(steps):
        sums, moved = _sums(rows, slopes, starts[-1]), 0.0
        for m, lo, hi in zip(models, starts, starts[1:], strict=False):
            n = len(weight[m])
            ridge = np.array([1 / c] * (n - 1) + [0.0])
            step = np.linalg.solve(sums[lo + n : hi].reshape(n, n) + np.diag(ridge + 1e-12), sums[lo : lo + n] + ridge * weight[m])
            weight[m] = weight[m] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    for s, t in models:
        w = weight[s, t][:-1] / scale[t, at[s]]
        found[s, t] = np.append(w, weight[s, t][-1] - w @ (centre + mean[t])[at[s]])
    return found


def scored(df: DataFrame, sets: Mapping[str, Sequence[str]], outcome: str, fold: str, keep: Sequence[str], k: int = 5, c: float = 1.0, clip: float = 1e-9, steps: int = 25) -> DataFrame:
    """keep columns, fold, outcome and p_<set> of each predictor set: every fold predicted by a model of the others.

    Rows with a null feature are left out of fits and get null, and so does a fold whose training rows have one class.
    """
    names = list(dict.fromkeys(x for features in sets.values() for x in features))
    renamed = {x: f"__x{i}" for i, x in enumerate(names)}
    rows = pinned(df.select(*keep, outcome, F.col(fold).cast("int").alias("fold"), F.col(fold).cast("int").alias("__fold"), F.col(outcome).cast("double").alias("__y"), *(F.col(x).cast("double").alias(n) for x, n in renamed.items())))
    weights = fitted(rows, {s: [renamed[x] for x in features] for s, features in sets.items()}, k, c, steps)

    def probability(s: str) -> Column:
        p = F.lit(None).cast("double")
        for t in range(k):
            if (w := weights[s, t]) is not None:
                z = sum((F.col(renamed[x]) * F.lit(float(v)) for x, v in zip(sets[s], w, strict=False)), F.lit(float(w[-1])))
                p = F.when(F.col("fold") == t, F.least(F.lit(1 - clip), F.greatest(F.lit(clip), 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))))).otherwise(p)
        return F.when(F.coalesce(*renamed.values()).isNotNull() & ~F.exists(F.array(*renamed.values()), lambda v: v.isNull()), p)

    return rows.select(*keep, "fold", outcome, *(probability(s).alias(f"p_{s}") for s in sets))


def cross_validated(df: DataFrame, features: Sequence[str], outcome: str, fold: str, keep: Sequence[str], k: int = 5, c: float = 1.0, clip: float = 1e-9, steps: int = 25) -> DataFrame:
    """keep columns, fold, outcome and p: `scored` for one predictor set."""
    return scored(df, {"": features}, outcome, fold, keep, k, c, clip, steps).withColumnRenamed("p_", "p")


def grouped_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): whole groups to k folds of like sizes, the largest first, each to the lightest fold.

    Groups of one size are dealt at once, so the driver sees the counts of sizes and not the groups: in order of size the fold loads are
    filled up; which group of a size goes where is settled by its rank. The same as `greedy_folds` but for groups of one size.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__size"))
    counts = sorted(((r["__size"], r["n"]) for r in sizes.groupBy("__size").agg(F.count("*").alias("n")).collect()), reverse=True)  # one row a size
    load, starts = [0] * k, []  # (size, rank from which, fold)
    for size, n in counts:
        rank, left = 0, n
        while left:
            low = min(load)
            level = [t for t in range(k) if load[t] == low]
            above = min((load[t] for t in range(k) if load[t] > low), default=None)
            rounds = max(1, left // len(level)) if above is None else max(1, min(left // len(level), -(-(above - low) // size)))
            for t in level[: left if rounds == 1 else None]:
                starts.append((size, rank, rank + rounds, t))
                rank, left, load[t] = rank + rounds, left - rounds, load[t] + size * rounds
    placed = with_range(sizes, [], group, "__place")
    ranked = sums_before(placed, ["__size"], F.col("__place"), [F.col(group)], {"__rank": F.lit(1)})
    runs = df.sparkSession.createDataFrame(starts, "__s long, __from long, __to long, fold int")
    return ranked.join(runs, (F.col("__size") == F.col("__s")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).select(group, "fold")


def log_loss(outcome: Column, p: Column) -> Column:
    y = outcome.cast("double")
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def incremental_gain(df: DataFrame, group: str, outcome: str, base: str, more: str) -> DataFrame:
    """(group, gain): how much lower the mean log loss of a richer model is, history by history."""
    return df.groupBy(group).agg(F.avg(log_loss(F.col(outcome), F.col(base)) - log_loss(F.col(outcome), F.col(more))).alias("gain"))


def compared(df: DataFrame, sets: dict[str, Sequence[str]], outcome: str, group: str, keep: Sequence[str], k: int = 5, c: float = 1.0) -> DataFrame:
    """keep columns, group, outcome and p_<name> of each predictor set, all over the same folds of whole groups and fitted together."""
    needed = df.select(*dict.fromkeys([*keep, group, outcome, *(x for features in sets.values() for x in features)]))
    folds = needed.join(grouped_folds(needed, group, k), group)
    return scored(folds, sets, outcome, "fold", [*keep, group], k, c).drop("fold")


#: Why no claim is made.
FEW, ONE_CLASS = "insufficient outcome variation or history groups; no claim", "one-class training fold; no claim"


def claim(df: DataFrame, sets: dict[str, Sequence[str]], base: str, more: str, outcome: str, group: str, keep: Sequence[str], k: int = 5, c: float = 1.0, n_draws: int = 200, seed: str = "81004") -> DataFrame:
    """One row per predictor set: model, available, reason, n, events, its metrics with average precision, and the gain of `more` over `base`.

    The gain is the mean over groups of how much lower the log loss is, with its bootstrap interval, on the row of `more`. Without a claim
    there is one row with its reason and no model: fewer than five groups, one class, or a training fold of one class.
    """
    spark = df.sparkSession
    df = pinned(df)
    facts = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0)).alias("events"), F.count_distinct(group).alias("groups")).first()
    kind = "model string, available boolean, reason string, n long, events long, auroc double, average_precision double, prevalence double, brier double, log_loss double, gain double, low double, high double"
    none = lambda why: spark.createDataFrame([(None, False, why, facts["n"], facts["events"], *[None] * 8)], kind)
    if facts["groups"] < 5 or not 0 < facts["events"] < facts["n"]:
        return none(FEW)
    found = pinned(compared(df, sets, outcome, group, keep, k, c))
    if not found.filter(F.greatest(*(F.col(f"p_{s}").isNull() for s in sets))).isEmpty():
        return none(ONE_CLASS)
    gain = incremental_gain(found, group, outcome, f"p_{base}", f"p_{more}").withColumn("__g", F.lit(0))
    interval = bootstrap_interval(gain, ["__g"], [group], "gain", n_draws, seed).select(F.lit(more).alias("model"), F.col("mean").alias("gain"), "low", "high")
    sides = None
    for s in sets:
        one = metrics(found, outcome, f"p_{s}").crossJoin(F.broadcast(average_precision(found, outcome, f"p_{s}")))  # one row each
        one = one.select(F.lit(s).alias("model"), F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), "n", F.lit(facts["events"]).alias("events"), "auroc", "average_precision", "prevalence", "brier", "log_loss")
        sides = one if sides is None else sides.unionByName(one)
    return sides.join(interval, "model", "left").select(*(x.split()[0] for x in kind.split(", ")))


def metrics(df: DataFrame, outcome: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """n, prevalence, AUROC (ties count half), Brier score, log loss and prevalence-only log loss.

    AUROC needs no global sort: positives and negatives are counted by distinct prediction, and ranks are sums over those counts.
    """
    counted = df.groupBy(*group, p).agg(F.sum(F.col(outcome).cast("double")).alias("pos"), F.sum(1.0 - F.col(outcome)).alias("neg"))
    ranked = sums_before(counted, list(group), F.floor(F.col(p) * 1024), [F.col(p)], {"neg_below": F.col("neg")})
    won = ranked.withColumn("w", F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).withColumn("__g", F.lit(0))
    auc = won.groupBy("__g", *group).agg((F.sum("w") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auroc"))
    y, q, rate = F.col(outcome).cast("double"), F.col(p), F.avg(F.col(outcome).cast("double"))
    sums = df.withColumn("__g", F.lit(0)).groupBy("__g", *group).agg(
        F.count("*").alias("n"), rate.alias("prevalence"), F.avg((q - y) * (q - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        F.when((rate > 0) & (rate < 1), -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))).alias("prevalence_log_loss"),
    )
    return sums.join(auc, ["__g", *group]).drop("__g")


def average_precision(df: DataFrame, outcome: str, p: str) -> DataFrame:
    """Sum over distinct predictions, from the top, of precision times the recall they add."""
    counted = df.groupBy(p).agg(F.sum(F.col(outcome).cast("double")).alias("pos"), F.count("*").alias("n"))
    total = counted.agg(F.sum("pos").alias("all"))
    run = sums_before(counted, [], -F.floor(F.col(p) * 1024), [F.col(p).desc()], {"tp": F.col("pos"), "seen": F.col("n")}).crossJoin(F.broadcast(total))
    return run.agg(F.sum((F.col("tp") + F.col("pos")) / (F.col("seen") + F.col("n")) * F.col("pos") / F.col("all")).alias("average_precision"))
