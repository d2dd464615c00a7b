"""numpy's own index draws made by many tasks: one generator's stream, cut into blocks.

numpy draws indices below n from 32-bit numbers, two of each output of PCG64, and passes over a number if the low half of its product with n is
below 2 ** 32 mod n. Whether a number is taken depends on itself alone, and the generator can be set to any output. So blocks are generated
apart: a first pass counts what each takes, sums of the counts give each block its place among the draws, and a second pass generates
the indices with their draw. Up to SENT rows are sent to the tasks, which add up their values by draw. Of more, HELD of a group's values at
most meet in a task with every so many blocks of its stream, which are generated there: indices are neither rows nor shuffled. A group of
more values has its blocks generated once for each HELD of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import Check, enforce
from .ordered import at_rank, between_ranks, sums_before, value_ranks
from .pinning import pinned
from .resample import SENT, numbered

BLOCK = 1 << 20  # 32-bit numbers of a block, an even number
SLICE = 1 << 16  # indices of an Arrow batch
TASKS = 2_000  # tasks that blocks are dealt to at most
HELD = 1 << 21  # a group's values that a task holds at most
RUN = 64  # blocks that one copy of these values meets, about
COPIES = 64  # of a group's values, at most


def taken(block: int, n: int, seed: int) -> np.ndarray:
    """The indices below n that a block of the seeded stream gives, in order."""
    if not 0 < n < 1 << 32:
        raise ValueError("indices are drawn below a number of 32 bits")
    bits = np.random.PCG64(seed)
    bits.advance(block * (BLOCK // 2))
    raw = bits.random_raw(BLOCK // 2)
    low = np.uint64(0xFFFFFFFF)
    wide = np.stack([raw & low, raw >> np.uint64(32)], axis=1).ravel() * np.uint64(n)
    return (wide[(wide & low) >= np.uint64((1 << 32) % n)] >> np.uint64(32)).astype(np.int64)


def _blocks(sizes: DataFrame, group: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """(group, n, __block, __before) of (group, n): the stream's blocks that a group needs, and the indices that those before it give."""
    total = F.col("n") * F.lit(n_draws)
    passed = total * F.col("n") / F.lit(float(1 << 32))  # numbers passed over, at most about so many
    blocks = F.ceil((total + 2 * passed + 8 * F.sqrt(passed) + 64) / F.lit(BLOCK))
    each = pinned(sizes.select(*group, F.col("n").cast("long").alias("n"), blocks.alias("__blocks")))
    parts = int(min(TASKS, each.agg(F.sum("__blocks")).first()[0] or 1))
    dealt = each.select(*group, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__block")).repartition(parts, *group, "__block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [len(taken(k, n, seed)) for k, n in zip(b.column("__block").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], [*b.schema.names, "__taken"])

    counted = pinned(dealt.mapInArrow(count, f"{_kinds(sizes, group)}n long, __block long, __taken long"))
    short = counted.groupBy(*group).agg(F.sum("__taken").alias("__all"), F.max(total).alias("__need")).filter("__all < __need")
    enforce([Check("draws_are_whole", short)])
    return sums_before(counted, group, F.floor(F.col("__block") / 1024), [F.col("__block")], {"__before": F.col("__taken")}).drop("__taken").repartition(parts, *group, "__block")


def _kinds(df: DataFrame, group: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in group)


def index_draws(sizes: DataFrame, group: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """(group, draw, i) of (group, n): row d of `default_rng(seed).integers(n, size=(n_draws, n))` for each group, every group from the stream's start."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                n, block, before = (b.column(c)[r].as_py() for c in ("n", "__block", "__before"))
                i = taken(block, n, seed)[: max(0, n * n_draws - before)]
                for lo in range(0, len(i), SLICE):
                    part = i[lo : lo + SLICE]
                    same = pa.array(np.full(len(part), r))
                    at = (before + lo + np.arange(len(part))) // n
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(same) for c in group), pa.array(at.astype(np.int32)), pa.array(part)], [*group, "draw", "i"])

    return _blocks(sizes, group, n_draws, seed).mapInArrow(draw, f"{_kinds(sizes, group)}draw int, i long")


def _sent_means(rows: DataFrame, group: Sequence[str], values: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """exact_means of at most SENT numbered rows: their values go to the tasks, which add them up by draw as they make the indices."""
    found, numbers = rows.toArrow(), {}
    x, at = np.column_stack([found[v].to_numpy() for v in values]), found["i"].to_numpy()
    whose = list(zip(*(found[c].to_pylist() for c in group), strict=True)) or [()] * len(x)
    of: dict[tuple, list[int]] = {}
    for r, g in enumerate(whose):
        of.setdefault(g, []).append(r)
    for g, rs in of.items():
        numbers[g] = x[rs][np.argsort(at[rs])]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                n, block, before = (b.column(c)[r].as_py() for c in ("n", "__block", "__before"))
                i = taken(block, n, seed)[: max(0, n * n_draws - before)]
                if len(i):
                    mine, first = numbers[tuple(b.column(c)[r].as_py() for c in group)], before // n
                    draw = (before + np.arange(len(i))) // n - first
                    sums = [pa.array(np.bincount(draw, mine[i, k])) for k in range(len(values))]
                    same = pa.array(np.full(draw[-1] + 1, r))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(same) for c in group), pa.array((first + np.arange(len(same))).astype(np.int32)), pa.array(np.bincount(draw)), *sums], [*group, "draw", "__n", *values])

    sums = _blocks(rows.filter("i = 0").select(*group, "n"), group, n_draws, seed).mapInArrow(add, f"{_kinds(rows, group)}draw int, __n long, " + ", ".join(f"`{v}` double" for v in values))
    return sums.groupBy(*group, "draw").agg(*((F.sum(v) / F.sum("__n")).alias(v) for v in values))


def _met_means(rows: DataFrame, group: Sequence[str], values: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """exact_means of any number of numbered rows: HELD of a group's values and a share of its blocks meet in one call, which adds up by draw."""
    n = F.col("n")
    copies = F.least(F.lit(COPIES), F.ceil(n * F.lit(n_draws) / F.lit(RUN * BLOCK))).cast("long")
    places = [*group, "__chunk", "__copy"]
    held = rows.select(*group, "i", *(F.col(v).cast("double").alias(v) for v in values), F.floor(F.col("i") / HELD).alias("__chunk"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("__copy"))
    blocks = _blocks(rows.filter("i = 0").select(*group, "n"), group, n_draws, seed)
    dealt = blocks.select("*", F.pmod("__block", copies).alias("__copy"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / HELD))).alias("__chunk"))

    def add(numbers: pa.Table, streams: pa.Table) -> pa.Table:
        kinds = {c: streams.schema.field(c).type for c in group}
        draws, counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros((0, len(values)))]
        if streams.num_rows and numbers.num_rows:
            first = int(streams.column("__chunk")[0].as_py()) * HELD
            x = np.empty((numbers.num_rows, len(values)))
            x[numbers.column("i").to_numpy() - first] = np.column_stack([numbers.column(v).to_numpy() for v in values])
            for size, block, before in zip(*(streams.column(c).to_pylist() for c in ("n", "__block", "__before")), strict=True):
                i = taken(block, size, seed)[: max(0, size * n_draws - before)]
                if len(i):
                    draw = (before + np.arange(len(i))) // size
                    if size > HELD:
                        here = (i >= first) & (i < first + len(x))
                        i, draw = i[here], draw[here]
                    low, at = before // size, i - first
                    got = np.bincount(draw - low)
                    draws.append(low + np.arange(len(got)))
                    counts.append(got)
                    sums.append(np.column_stack([np.bincount(draw - low, x[at, k]) for k in range(len(values))]))
        draw, total = np.concatenate(draws), np.concatenate(sums)
        same = {c: pa.array([streams.column(c)[0].as_py()] * len(draw) if len(draw) else [], kinds[c]) for c in group}
        return pa.table({**same, "draw": pa.array(draw.astype(np.int32)), "__n": pa.array(np.concatenate(counts).astype(np.int64)), **{v: pa.array(np.ascontiguousarray(total[:, k])) for k, v in enumerate(values)}})

    sums = held.groupBy(*places).cogroup(dealt.groupBy(*places)).applyInArrow(add, f"{_kinds(rows, group)}draw int, __n long, " + ", ".join(f"`{v}` double" for v in values))
    return sums.groupBy(*group, "draw").agg(*((F.sum(v) / F.sum("__n")).alias(v) for v in values))


def exact_means(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """(group, draw, mean of each value) of numpy's index draws over each group's rows in the stated order, which is part of the result."""
    places = [f"__o{k}" for k in range(len(order))]
    rows = pinned(numbered(df.select(*group, *(F.col(c).alias(p) for c, p in zip(order, places, strict=True)), *values), group, places).select(*group, "i", "n", *values))
    if 0 < rows.count() <= SENT:
        return _sent_means(rows, group, values, n_draws, seed)
    return _met_means(rows, group, values, n_draws, seed)


def _finite(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    found = pinned(df.select(*group, *(c for c in order if c != value), F.col(value).cast("double").alias(value)))
    odd = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    enforce([Check("finite", found.filter(odd))])
    return found


def exact_intervals(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n_draws: int = 2000, seed: int = 81004, level: float = 0.95) -> DataFrame:
    """(group, n, mean, low, high): the index bootstrap of numpy's stream for every group, to rounding. A null or non-finite value raises.

    A table without rows gives none. Groups of null keys are left out, and orders with ties aren't settled: give whole keys.
    """
    df = _finite(df, group, order, value)  # one copy, which all that follows reads
    means = exact_means(df, group, order, [value], n_draws, seed)
    ends = means.groupBy(*group).agg(F.percentile(value, (1 - level) / 2).alias("low"), F.percentile(value, (1 + level) / 2).alias("high"))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ends, list(group))


def exact_summaries(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n_draws: int = 2000, seed: int = 73021) -> DataFrame:
    """exact_intervals at 95 % with median, trimmed (mean, int(n / 10) values off both ends) and fraction_positive; ranks are of counted values."""
    df = pinned(df.select(*dict.fromkeys([*group, *order, value])))
    ends = exact_intervals(df, group, order, value, n_draws, seed)
    t, v = F.col("total"), F.col(value)
    cut = F.floor(t * F.lit(0.1))
    facts = value_ranks(df.select(*group, v.cast("double").alias(value)), group, value).groupBy(*group).agg(
        ((at_rank(F.floor((t - 1) / 2), value) + at_rank(F.floor(t / 2), value)) / 2).alias("median"), between_ranks(cut, t - cut, value).alias("trimmed"), (F.sum(F.when(v > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction_positive"),
    )
    return ends.join(facts, list(group)).select(*group, "n", "mean", "median", "trimmed", "fraction_positive", "low", "high")
