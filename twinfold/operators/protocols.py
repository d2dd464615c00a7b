"""Contrasts of single protocols, composed of the general ones: orders, versions, acceptance, focal validity, stability, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contrasts import cell_mean


def order_contrasts(df: DataFrame, keys: Sequence[str], historical: str, current: str, value: str) -> DataFrame:
    """Means by aligned and reversed order, by each of the four orders, and the interaction of the two factors. Null if a cell is missing."""
    h, c = F.col(historical), F.col(current)
    e = {(i, j): cell_mean((h == i) & (c == j), value) for i in (0, 1) for j in (0, 1)}
    return df.groupBy(*keys).agg(
        ((e[0, 0] + e[1, 1]) / 2).alias("aligned"), ((e[0, 1] + e[1, 0]) / 2).alias("reversed"), *(x.alias(f"order_{i}{j}") for (i, j), x in e.items()), ((e[0, 0] + e[1, 1] - e[0, 1] - e[1, 0]) / 2).alias("interaction")
    )


def version_selectivity(df: DataFrame, history: str, binding: str, query: str, value: str, axes: Sequence[str] = ("x", "z")) -> DataFrame:
    """Per axis: how much more a version's own query moves than the other version's, averaged over both versions.

    Bindings and queries are named old_x, new_x, old_z, new_z. `selectivity` is the mean of the axes, null unless all cells are there.
    """
    e = lambda b, q: cell_mean((F.col(binding) == b) & (F.col(query) == q), value)
    s = {a: ((e(f"old_{a}", f"old_{a}") - e(f"old_{a}", f"new_{a}")) + (e(f"new_{a}", f"new_{a}") - e(f"new_{a}", f"old_{a}"))) / 2 for a in axes}
    total = sum(s.values(), F.lit(0.0)) / len(s)
    return df.groupBy(history).agg(*(x.alias(f"selectivity_{a}") for a, x in s.items()), total.alias("selectivity"))


def acceptance_effects(df: DataFrame, keys: Sequence[str], status: str, field: str, value: str) -> DataFrame:
    """2 x 2 of status (applied, ignored) by field (proposed, initial): effect of applying on each field, and their difference."""
    e = lambda s, f: cell_mean((F.col(status) == s) & (F.col(field) == f), value)
    proposed, initial = e("applied", "proposed") - e("ignored", "proposed"), e("ignored", "initial") - e("applied", "initial")
    return df.groupBy(*keys).agg(proposed.alias("proposed_effect"), initial.alias("initial_effect"), (proposed + initial).alias("acceptance"))


def focal_validity(df: DataFrame, history: str, axis: str, position: str, status: str, field: str, value: str) -> DataFrame:
    """acceptance_effects per axis after averaging positions, with a symmetric axis that is the mean of the two; null if one is missing."""
    even = df.groupBy(history, axis, status, field, position).agg(F.avg(value).alias("__p")).groupBy(history, axis, status, field).agg(F.avg("__p").alias(value))
    each = acceptance_effects(even, [history, axis], status, field, value)
    both = each.groupBy(history).agg(*(F.when(F.count(c) == 2, F.avg(c)).alias(c) for c in ("proposed_effect", "initial_effect", "acceptance"))).withColumn(axis, F.lit("symmetric"))
    return each.unionByName(both)


def answer_stability(df: DataFrame, keys: Sequence[str], member: str, correct: str, margin: str) -> DataFrame:
    """Accuracy and margin of the baseline and the edited records and their changes, for edits that must not change the answer."""
    m = F.col(member)
    acc = [F.avg(F.when(m == i, F.col(correct).cast("double"))) for i in (0, 1)]
    mar = [cell_mean(m == i, margin) for i in (0, 1)]
    return df.groupBy(*keys).agg(acc[0].alias("accuracy_0"), acc[1].alias("accuracy_1"), mar[0].alias("margin_0"), mar[1].alias("margin_1"), (acc[1] - acc[0]).alias("accuracy_change"), (mar[1] - mar[0]).alias("margin_change"))


def position_table(df: DataFrame, keys: Sequence[str], position: str, direction: str, directions: tuple, role: str, value: str) -> DataFrame:
    """One row per absolute position: mean by direction, their mean, and all roles that the position has (sorted, joined by |)."""
    a, b = (cell_mean(F.col(direction) == d, value) for d in directions)
    return df.groupBy(*keys, position).agg(a.alias("first"), b.alias("second"), ((a + b) / 2).alias("both"), F.array_join(F.array_sort(F.collect_set(role)), "|").alias("roles"))


def workload(levels: DataFrame, per_cell: int, seconds: float) -> DataFrame:
    """Cells, records and hours of a task grid."""
    return levels.agg(F.count("*").alias("cells"), (F.count("*") * per_cell).alias("records"), (F.count("*") * per_cell * F.lit(seconds) / 3600).alias("hours"))
