"""Linear probes of activations: multinomial ridge models of every cell, fold and strength, fitted together.

A cell is one of a protocol's few combinations (a layer, or query x slot x layer). Rows are pinned once. A step of all models is one scan: each
task multiplies its rows with the weights of all models of their cell, adds up losses and gradients in numpy, and gives one vector; Spark
adds these up, and the driver, which holds models x classes x (features + 1) numbers, moves each model by its own L-BFGS. So neither
cells nor folds nor strengths are fitted one after another, and no task or driver sees a cell's rows together.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import ValidationError
from .ordered import sums_before, with_range
from .pinning import pinned
from .predict import grouped_folds, summed
from .resample import bootstrap_interval

STEP = 1024  # rows multiplied at once
MEMORY = 10  # steps that L-BFGS remembers


@dataclass(frozen=True)
class Probe:
    """A model of the rows of a cell whose part is one of `parts`, with a penalty of |w|^2 / (2 strength) on the summed loss."""

    cell: int
    parts: frozenset[int]
    strength: float


@dataclass(frozen=True)
class Scale:
    """Of a cell: the centre that features are taken from, and of each set of parts their number, mean (from the centre) and deviation."""

    centre: np.ndarray
    sets: dict[frozenset[int], tuple[float, np.ndarray, np.ndarray]]


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, its rows' places in the batch, features, part, label) in blocks of STEP rows."""
    cell, part, y = (b.column(n).to_numpy(zero_copy_only=False) for n in ("__cell", "__part", "__y"))
    x = b.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    for k in np.unique(cell):
        at = np.flatnonzero(cell == k)
        for lo in range(0, len(at), STEP):
            i = at[lo : lo + STEP]
            yield int(k), i, x[i].astype(float), part[i], y[i]


def _scales(rows: DataFrame, counts: Mapping[tuple[int, int], int], width: int, sets: Mapping[int, set[frozenset[int]]]) -> dict[int, Scale]:
    """Means and deviations (of the population, 1 where there is none) of each cell's sets of parts, from two scans."""
    places = {k: i for i, k in enumerate(sorted(counts))}

    def powers(centre: dict[int, np.ndarray] | None) -> Callable[[pa.RecordBatch], np.ndarray]:
        def run(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(places), width))
            for cell, _, x, part, _ in _blocks(b):
                for p in np.unique(part):
                    out[places[cell, int(p)]] += x[part == p].sum(axis=0) if centre is None else ((x[part == p] - centre[cell]) ** 2).sum(axis=0)
            return out.ravel()

        return run

    first = summed(rows, powers(None), len(places) * width).reshape(-1, width)
    of = {cell: [k for k in places if k[0] == cell] for cell in {k[0] for k in places}}
    centre = {cell: sum(first[places[k]] for k in ks) / sum(counts[k] for k in ks) for cell, ks in of.items()}
    second = summed(rows, powers(centre), len(places) * width).reshape(-1, width)
    found = {}
    for cell, chosen in sets.items():
        each = {}
        for parts in chosen:
            ks = [k for k in of[cell] if k[1] in parts]
            n = sum(counts[k] for k in ks)
            mean = sum(first[places[k]] for k in ks) / n - centre[cell]
            scale = np.sqrt(np.maximum(0.0, sum(second[places[k]] for k in ks) / n - mean**2))
            each[parts] = (n, mean, np.where(scale > 1e-12 * (1 + np.abs(mean)), scale, 1.0))
        found[cell] = Scale(centre[cell], each)
    return found


def _logits(x: np.ndarray, scale: Scale, models: Sequence[Probe], weights: Mapping[Probe, np.ndarray]) -> np.ndarray:
    """(row, model, class): log probabilities of a cell's rows; weights are of standardised features, the intercept last."""
    plain, shift = [], []
    for m in models:
        _, mean, sd = scale.sets[m.parts]
        w = weights[m][:, :-1] / sd
        plain.append(w)
        shift.append(weights[m][:, -1] - w @ mean)
    z = ((x - scale.centre) @ np.concatenate(plain).T + np.concatenate(shift)).reshape(len(x), len(models), -1)
    z -= z.max(axis=2, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=2, keepdims=True))


def minimised(evaluate: Callable[[dict], dict], starts: Mapping[Hashable, np.ndarray], tolerance: float = 1e-6, rounds: int = 500) -> dict:
    """Minimisers of convex functions by L-BFGS, each with its own steps, all evaluated together: evaluate({name: x}) gives {name: (f, gradient)}.

    A function is done when no number of its gradient exceeds the tolerance; only those that aren't are evaluated again.
    """
    at, pairs = dict(starts), {m: [] for m in starts}
    here = evaluate(at) if at else {}

    def way(m: Hashable) -> np.ndarray:
        d, kept = here[m][1].copy(), []
        for s, y in reversed(pairs[m]):
            kept.append((s @ d) / (s @ y))
            d -= kept[-1] * y
        if pairs[m]:
            s, y = pairs[m][-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs[m], reversed(kept), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        return -d

    open_ = [m for m in at if np.abs(here[m][1]).max() > tolerance]
    ways = {m: way(m) for m in open_}
    size = {m: 1 / max(1.0, float(np.linalg.norm(ways[m]))) for m in open_}
    for _ in range(rounds):
        if not open_:
            return at
        there = evaluate({m: at[m] + size[m] * ways[m] for m in open_})
        for m in list(open_):
            (f, g), (f2, g2) = here[m], there[m]
            if f2 > f + 1e-4 * size[m] * (g @ ways[m]) + 1e-13 * abs(f) and size[m] > 1e-12:
                size[m] /= 2
                continue
            moved = size[m] * ways[m]
            if moved @ (g2 - g) > 1e-14 * (moved @ moved):
                pairs[m] = [*pairs[m], (moved, g2 - g)][-MEMORY:]
            at[m], here[m] = at[m] + moved, there[m]
            if np.abs(g2).max() <= tolerance:
                open_.remove(m)
            else:
                ways[m], size[m] = way(m), 1.0
    warnings.warn(f"{len(open_)} probes stopped after {rounds} steps", stacklevel=2)
    return at


def fitted(rows: DataFrame, scales: Mapping[int, Scale], classes: Mapping[int, int], models: Sequence[Probe], tolerance: float = 1e-6) -> dict[Probe, np.ndarray]:
    """Weights (class x features, intercept last and unpenalised) of each probe on standardised rows.

    rows: __cell, __part, __y (0 to the cell's classes - 1) and __v, pinned. Two classes have the penalty of one weight vector, their difference.
    """

    def evaluate(at: dict[Probe, np.ndarray]) -> dict[Probe, tuple[float, np.ndarray]]:
        weights = {m: w.reshape(classes[m.cell], -1) for m, w in at.items()}
        of: dict[int, list[Probe]] = {}
        for m in weights:
            of.setdefault(m.cell, []).append(m)
        starts, total = {}, 0
        for m, w in weights.items():
            starts[m], total = total, total + 1 + w.size

        def run(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(total)
            for cell, _, x, part, y in _blocks(b):
                if cell not in of:
                    continue
                here = np.array([[p in m.parts for m in of[cell]] for p in part])
                log_p = _logits(x, scales[cell], of[cell], weights)
                loss = -(log_p[np.arange(len(y)), :, y] * here).sum(axis=0)
                rest = np.exp(log_p)
                rest[np.arange(len(y)), :, y] -= 1
                rest *= here[:, :, None]
                flat = rest.reshape(len(y), -1)
                slope = (flat.T @ (x - scales[cell].centre)).reshape(len(of[cell]), classes[cell], -1)
                for i, m in enumerate(of[cell]):
                    part_sums = np.hstack([slope[i], rest[:, i].sum(axis=0)[:, None]])
                    out[starts[m] : starts[m] + 1 + part_sums.size] += np.append(loss[i], part_sums)
            return out

        sums, found = summed(rows, run, total), {}
        for m, w in weights.items():
            n, mean, sd = scales[m.cell].sets[m.parts]
            plain = sums[starts[m] + 1 : starts[m] + 1 + w.size].reshape(w.shape)
            inner = w[:, :-1]
            ridge = (2 if len(w) == 2 else 1) / m.strength
            slope = np.hstack([(plain[:, :-1] - np.outer(plain[:, -1], mean)) / sd + ridge * inner, plain[:, -1:]])
            found[m] = ((sums[starts[m]] + ridge * (inner**2).sum() / 2) / n, slope.ravel() / n)
        return found

    width = {cell: len(s.centre) + 1 for cell, s in scales.items()}
    found = minimised(evaluate, {m: np.zeros(classes[m.cell] * width[m.cell]) for m in models}, tolerance)
    return {m: w.reshape(classes[m.cell], -1) for m, w in found.items()}


def _hits(rows: DataFrame, scales: Mapping[int, Scale], weights: Mapping[Probe, np.ndarray], n_parts: int) -> dict[tuple[Probe, int], int]:
    """(probe, part) -> rows of that part which the probe gets right. A label that it never saw (-1) is missed."""
    models = list(weights)

    def run(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(models), n_parts))
        for cell, _, x, part, y in _blocks(b):
            here = [m for m in models if m.cell == cell]
            if here:
                right = _logits(x, scales[cell], here, weights).argmax(axis=2) == y[:, None]
                for i, m in enumerate(here):
                    out[models.index(m)] += np.bincount(part, right[:, i], n_parts)
        return out.ravel()

    found = summed(rows, run, len(models) * n_parts).reshape(-1, n_parts)
    return {(m, p): int(found[i, p]) for i, m in enumerate(models) for p in range(n_parts)}


def _rows(df: DataFrame, keys: Sequence[str], cells: Sequence[tuple], vector: str, label: str, part: Column, key: str | None) -> tuple[DataFrame, dict, int]:
    """(rows, counts, width): __cell, __part, label, __v and __id of the stated cells' rows, pinned; rows by (cell, part, label); the vectors' length.

    A null label, part or vector, a number that isn't finite and vectors of several lengths raise. Labels are a protocol's few candidates.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    wanted = df.sparkSession.createDataFrame([(*cell, i) for i, cell in enumerate(cells)], f"{kinds}, __cell int")
    own = F.col(key).cast("string") if key else F.md5(F.col(vector).cast("string"))
    found = df.join(F.broadcast(wanted), list(keys)).select("__cell", part.cast("int").alias("__part"), F.col(label).alias("label"), F.col(vector).alias("__v"), own.alias("__id"))
    rows = pinned(found)
    odd = F.exists("__v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bad = F.count_if(F.coalesce(odd, F.lit(True)) | F.col("__part").isNull() | F.col("label").isNull())
    facts = rows.groupBy("__cell", "__part", "label").agg(F.count("*").alias("n"), F.min(F.size("__v")).alias("low"), F.max(F.size("__v")).alias("high"), bad.alias("bad")).collect()
    if any(r["bad"] for r in facts) or len({w for r in facts for w in (r["low"], r["high"])}) > 1:
        raise ValidationError("probes need a label, a part and finite numbers, as many in each vector")
    return rows, {(r["__cell"], r["__part"], r["label"]): r["n"] for r in facts}, facts[0]["low"] if facts else 0


def _numbered(rows: DataFrame, names: Mapping[int, Sequence]) -> DataFrame:
    """rows with __y, the label's place among its cell's names; -1 for others."""
    kind = rows.schema["label"].dataType.simpleString()
    places = rows.sparkSession.createDataFrame([(cell, v, i) for cell, vs in names.items() for i, v in enumerate(vs)], f"__cell int, label {kind}, __y int")
    return rows.join(F.broadcast(places), ["__cell", "label"], "left").withColumn("__y", F.coalesce("__y", F.lit(-1)))


def permuted(train: DataFrame, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """train with its labels permuted: a row takes the label of the row whose rank by one seeded hash is its own by another, within `by`."""

    def ranked(*parts: Column | str) -> DataFrame:
        rows = with_range(train.withColumn("__h", F.md5(F.concat_ws(":", *parts, *by))), by, "__h", "__place")
        return sums_before(rows, by, F.col("__place"), [F.col("__h"), F.col("__id")], {"__r": F.lit(1)}).drop("__h", "__place")

    a, b = ranked("__id", F.lit(seed)), ranked(F.lit(seed), "__id")
    return a.drop("label").join(b.select(*by, "__r", "label"), [*by, "__r"]).drop("__r")


SPLITS = {"train": 0, "validation": 1, "test": 2}


def probe_curve(df: DataFrame, layer: str, layers: Sequence[int], vector: str, label: str, split: str, strengths: Sequence[float] = (0.01, 0.1, 1.0, 10.0), seed: int = 0, key: str | None = None) -> DataFrame:
    """One row per layer (a protocol's few layers), all fitted together.

    strength: the first best on `validation`; accuracy: on `test`, of the fit on `train`; shuffled: the same with permuted training labels; chance:
    one by the number of training labels; majority: the commonest one's share; train_accuracy, validation_accuracy; n_train. Features are
    standardised by the training rows. The null permutes the training labels within each layer by seeded hashes of `key` (of the vector, if not
    given), so it is the same at any partitioning. Rows of other splits are left out; a layer without training rows, or with one label, has
    nulls; an accuracy over no rows is null.
    """
    part = F.coalesce(*(F.when(F.col(split) == s, i) for s, i in SPLITS.items()))
    rows, counts, width = _rows(df.filter(F.col(split).isin(*SPLITS)), [layer], [(k,) for k in layers], vector, label, part, key)
    names = {cell: sorted(v for c, p, v in counts if (c, p) == (cell, 0)) for cell in range(len(layers))}
    names = {cell: vs for cell, vs in names.items() if len(vs) > 1}
    sizes: dict[tuple[int, int], int] = {}
    for (cell, p, _), n in counts.items():
        sizes[cell, p] = sizes.get((cell, p), 0) + n
    out = {cell: [None] * 7 + [sizes.get((cell, 0), 0)] for cell in range(len(layers))}
    if names:
        train = frozenset([0])
        coded = pinned(_numbered(rows, names))
        scales = _scales(coded, sizes, width, {cell: {train} for cell in names})
        classes = {cell: len(vs) for cell, vs in names.items()}
        weights = fitted(coded.filter("__part = 0"), scales, classes, [Probe(cell, train, c) for cell in names for c in strengths])
        hits = _hits(coded, scales, weights, 3)
        best = {cell: max((Probe(cell, train, c) for c in strengths), key=lambda m: hits[m, 1]) for cell in names}  # the first of equals
        null = pinned(_numbered(permuted(rows.filter("__part = 0").select("__cell", "__id", "__part", "label", "__v"), seed, ["__cell"]), names))
        missed = _hits(coded.filter("__part = 2"), scales, fitted(null, scales, classes, list(best.values())), 3)
        share = lambda found, m, p: found[m, p] / sizes[m.cell, p] if sizes.get((m.cell, p)) else None
        for cell, m in best.items():
            n = sizes[cell, 0]
            top = max(counts[cell, 0, v] for v in names[cell]) / n
            out[cell] = [float(m.strength), share(hits, m, 2), share(missed, m, 2), 1 / classes[cell], top, share(hits, m, 0), share(hits, m, 1), n]
    kind = df.schema[layer].dataType.simpleString()
    schema = f"layer {kind}, strength double, accuracy double, shuffled double, chance double, majority double, train_accuracy double, validation_accuracy double, n_train long"
    return df.sparkSession.createDataFrame([(k, *out[i]) for i, k in enumerate(layers)], schema)


def probe_layer(df: DataFrame, vector: str, label: str, split: str, strengths: Sequence[float] = (0.01, 0.1, 1.0, 10.0), seed: int = 0, key: str | None = None) -> dict:
    """probe_curve's row of a table that is one layer."""
    row = probe_curve(df.withColumn("__layer", F.lit(0)), "__layer", [0], vector, label, split, strengths, seed, key).first().asDict()
    del row["layer"]
    return row


def grouped_probes(
    df: DataFrame, keys: Sequence[str], cells: Sequence[tuple], vector: str, label: str, group: str, folds: int = 5, strength: float = 1.0, key: str | None = None, n_draws: int = 200, seed: str = "20260929"
) -> DataFrame:
    """One row per cell (a protocol's few query x slot x layer combinations): out-of-fold accuracy with its bootstrap interval over rows, balanced
    accuracy, log loss, and `folds`, the same of each fold.

    Whole groups are dealt to folds; each fold is predicted by a fit on the standardised rows of the others, all cells and folds together. A
    cell of fewer rows than folds or of one label, and a training fold that lacks a label, raise. Rows are drawn in the order of `key` (of a
    digest of the vector, if not given). balanced_accuracy is the mean over the labels that occur.
    """
    with_fold = df.join(grouped_folds(df, group, folds), group)
    rows, counts, width = _rows(with_fold, keys, cells, vector, label, F.col("fold"), key)
    names = {i: sorted({v for c, _, v in counts if c == i}) for i in range(len(cells))}
    sizes: dict[tuple[int, int], int] = {}
    for (cell, p, _), n in counts.items():
        sizes[cell, p] = sizes.get((cell, p), 0) + n
    for i, cell in enumerate(cells):
        if len(names[i]) < 2 or sum(n for (c, _), n in sizes.items() if c == i) < folds:
            raise ValidationError(f"too few rows or labels at {cell}")
        if any({v for c, p, v in counts if c == i and p != f} < set(names[i]) for f in range(folds)):
            raise ValidationError(f"a training fold misses a class at {cell}")
    every = frozenset(range(folds))
    models = {(i, f): Probe(i, every - {f}, strength) for i, f in sizes}
    coded = pinned(_numbered(rows, names))
    scales = _scales(coded, sizes, width, {i: {m.parts for m in models.values() if m.cell == i} for i in names})
    weights = fitted(coded, scales, {i: len(vs) for i, vs in names.items()}, list(models.values()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, loss = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for cell, at, x, part, y in _blocks(b):
                for f in np.unique(part):
                    mine = part == f
                    m = models[cell, int(f)]
                    log_p = _logits(x[mine], scales[cell], [m], weights)[:, 0]
                    hit[at[mine]] = log_p.argmax(axis=1) == y[mine]
                    loss[at[mine]] = -np.maximum(log_p[np.arange(len(log_p)), y[mine]], np.log(1e-15))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("__cell", "__part", "__y", "__id")), pa.array(hit), pa.array(loss)], ["__cell", "__part", "__y", "__id", "hit", "loss"])

    scored = pinned(coded.mapInArrow(score, "__cell int, __part int, __y int, __id string, hit double, loss double"))
    per = scored.groupBy("__cell", "__part", "__y").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("loss").alias("loss"))
    facts = (F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"), (F.sum("loss") / F.sum("n")).alias("log_loss"))
    each = per.groupBy("__cell", "__part").agg(*facts).groupBy("__cell").agg(F.sort_array(F.collect_list(F.struct(F.col("__part").alias("fold"), "n", "accuracy", "balanced_accuracy", "log_loss"))).alias("folds"))  # a cell's few folds
    whole = per.groupBy("__cell", "__y").agg(*(F.sum(x).alias(x) for x in ("n", "hits", "loss"))).groupBy("__cell").agg(*facts)
    ends = bootstrap_interval(scored, ["__cell"], ["__id"], "hit", n_draws, seed).select("__cell", "low", "high")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    named = F.broadcast(df.sparkSession.createDataFrame([(*cell, i) for i, cell in enumerate(cells)], f"{kinds}, __cell int"))
    return named.join(whole, "__cell").join(ends, "__cell").join(each, "__cell").select(*keys, "n", "accuracy", "low", "high", "balanced_accuracy", "log_loss", "folds")
