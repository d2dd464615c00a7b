"""History contrasts: differences of effects between the cells of one history, by conditional aggregation on the history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import enforce, rule


def cell_mean(when: Column, value: str) -> Column:
    """Mean of value over a history's rows in a cell; null if it has none."""
    return F.avg(F.when(when, F.col(value)))


def pivot_cells(df: DataFrame, keys: Sequence[str], cell: str, cells: Mapping[str, object], value: str) -> DataFrame:
    """One row per key, a column (name) for each cell's mean value. Cells are named, so the plan never looks for them."""
    return df.groupBy(*keys).agg(*(cell_mean(F.col(cell) == v, value).alias(name) for name, v in cells.items()))


def averaged_orders(df: DataFrame, keys: Sequence[str], nuisance: Sequence[str], orders: int, value: str) -> DataFrame:
    """(keys, value): the mean over nuisance orders of each order's own mean, however many rows an order has, for contrasts that come after.

    Null for keys that lack one of so many orders, or that have a value of none in one: their contrasts would compare different orders.
    """
    each = df.groupBy(*keys, *nuisance).agg(F.avg(value).alias("__m"))
    return each.groupBy(*keys).agg(F.when(F.count("__m") == orders, F.avg("__m")).alias(value))


def symmetric_relevance(df: DataFrame, keys: Sequence[str], edited: str, query: str, value: str, axes: tuple[str, str]) -> DataFrame:
    """R = ((E_xx - E_xz) + (E_zz - E_zx)) / 2 per key; E_eq is the mean effect of editing e under query q. Null if a cell is missing."""
    x, z = axes
    e = lambda a, b: cell_mean((F.col(edited) == a) & (F.col(query) == b), value)
    return df.groupBy(*keys).agg((((e(x, x) - e(x, z)) + (e(z, z) - e(z, x))) / 2).alias("relevance"))


def with_all(df: DataFrame, column: str, name: str = "all") -> DataFrame:
    """Each row twice: under its own value of a column, and under `name`."""
    return df.withColumn(column, F.explode(F.array(F.lit(name), F.col(column))))


def factorial(df: DataFrame, keys: Sequence[str], factor: str, levels: tuple, construction: str, constructions: tuple, value: str) -> DataFrame:
    """Effect of a two-level factor in each of two constructions, and their interaction."""
    e = lambda c, f: cell_mean((F.col(construction) == c) & (F.col(factor) == f), value)
    (a, b), (low, high) = constructions, levels
    first, second = e(a, high) - e(a, low), e(b, high) - e(b, low)
    return df.groupBy(*keys).agg(first.alias("effect_first"), second.alias("effect_second"), (first - second).alias("interaction"))


def version_contrasts(df: DataFrame, keys: Sequence[str], version: str, value: str) -> DataFrame:
    """Each version's value less the one before, and the one before less the mean of all older ones (null where they don't exist)."""
    by = Window.partitionBy(*keys).orderBy(version)
    before, older = F.lag(value).over(by), F.avg(value).over(by.rowsBetween(Window.unboundedPreceding, -2))
    return df.select("*", (F.col(value) - before).alias("current_minus_previous"), (before - older).alias("previous_minus_older"))


def best_window(df: DataFrame, history: str, layer: str, value: str, width: int) -> DataFrame:
    """The contiguous window of layers with the largest mean over histories that have all layers; the first window on a tie.

    Histories' layers are averaged first, so the search runs over the few layers and not over rows.
    """
    n = df.agg(F.count_distinct(layer).alias("layers"))
    full = df.groupBy(history).agg(F.count_distinct(layer).alias("__n")).crossJoin(F.broadcast(n)).filter("__n = layers").select(history)
    means = df.join(full, history, "left_semi").groupBy(layer).agg(F.avg(value).alias("__mean"))
    by = Window.partitionBy(F.lit(0)).orderBy(layer).rowsBetween(0, width - 1)  # one row per layer
    windows = means.select(F.col(layer).alias("first_layer"), F.avg("__mean").over(by).alias("window_mean"), F.count("*").over(by).alias("__k")).filter(F.col("__k") == width)
    return windows.orderBy(F.col("window_mean").desc(), "first_layer").limit(1).drop("__k")


def depth_crossings(df: DataFrame, layer: str, value: str, shares: Sequence[float]) -> DataFrame:
    """The first layer whose mean reaches each share of the last layer's mean, and the layer of the largest absolute mean."""
    means = df.groupBy(layer).agg(F.avg(value).alias("m"))
    late = means.agg(F.max_by("m", layer).alias("late"))
    both = means.crossJoin(F.broadcast(late))
    names = {s: f"first_{round(100 * s)}" for s in shares}
    return both.agg(*(F.min(F.when(F.col("m") >= s * F.col("late"), F.col(layer))).alias(names[s]) for s in shares), F.max(F.struct(F.abs("m").alias("a"), (-F.col(layer)).alias("minus")))["minus"].alias("__p")).withColumn("peak_layer", -F.col("__p")).drop("__p")


def depth_window_contrast(df: DataFrame, keys: Sequence[str], depth: str, value: str, early: float = 0.25, late: float = 0.75) -> DataFrame:
    """Mean value at normalized depths of at least `late` less that at most `early`."""
    return df.groupBy(*keys).agg((cell_mean(F.col(depth) >= late, value) - cell_mean(F.col(depth) <= early, value)).alias("late_minus_early"))


def position_factorial(df: DataFrame, keys: Sequence[str], orientation: str, value: str) -> DataFrame:
    """(d0 + d1) / 4, the position effect, and (d0 - d1) / 4, the literal name's, of two orientations' differences."""
    d = lambda o: cell_mean(F.col(orientation) == o, value)
    return df.groupBy(*keys).agg(((d(0) + d(1)) / 4).alias("position_effect"), ((d(0) - d(1)) / 4).alias("name_effect"))


def head_profiles(df: DataFrame, keys: Sequence[str], position: str, direction: str, query: str, relevant: str, value: str) -> DataFrame:
    """Mean over positions, then over directions, then the relevant query's less the mean of the others."""
    by_position = df.groupBy(*keys, query, direction, position).agg(F.avg(value).alias("__p"))
    by_direction = by_position.groupBy(*keys, query, direction).agg(F.avg("__p").alias("__d"))
    by_query = by_direction.groupBy(*keys, query).agg(F.avg("__d").alias("__q"))
    return by_query.groupBy(*keys).agg((cell_mean(F.col(query) == relevant, "__q") - cell_mean(F.col(query) != relevant, "__q")).alias("relevant_minus_other"))


def parts_against_whole(parts: DataFrame, whole: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of the parts by key, joined with the whole, and their difference."""
    summed = parts.groupBy(*keys).agg(F.sum(value).alias("parts"))
    return summed.join(whole.select(*keys, F.col(value).alias("whole")), list(keys)).withColumn("difference", F.col("parts") - F.col("whole"))


def status_metric(df: DataFrame, rules: Mapping[tuple[str, str], tuple[str, str]], condition: str, field: str, status: str, name: str = "metric") -> DataFrame:
    """df with the metric's name that a condition and an edited field stand for; raises if a row's semantic status isn't the one they imply.

    rules: (condition, field) -> (metric, expected status). A row that no rule knows raises, too.
    """
    here = lambda c, f: (F.col(condition) == c) & (F.col(field) == f)
    metric = F.coalesce(*(F.when(here(c, f), F.lit(m)) for (c, f), (m, _) in rules.items()))
    expected = F.coalesce(*(F.when(here(c, f), F.lit(s)) for (c, f), (_, s) in rules.items()))
    enforce([rule(df, "semantic_status", F.col(status) == expected)])
    return df.withColumn(name, metric)


def construction_differences(df: DataFrame, keys: Sequence[str], construction: str, names: Sequence[str], value: str) -> DataFrame:
    """Each construction's mean and, for every two of them in order, the first less the second: columns a_minus_b."""
    wide = pivot_cells(df, keys, construction, {n: n for n in names}, value)
    return wide.select("*", *((F.col(a) - F.col(b)).alias(f"{a}_minus_{b}") for i, a in enumerate(names) for b in names[i + 1 :]))


def late_fractions(df: DataFrame, site: str, layer: str, value: str) -> DataFrame:
    """Mean by site and layer, and its fraction of the site's last layer's mean (null where that is 0)."""
    means = df.groupBy(site, layer).agg(F.avg(value).alias("mean"))
    late = means.groupBy(site).agg(F.max_by("mean", layer).alias("late"))
    return means.join(late, site).select(site, layer, "mean", F.try_divide("mean", "late").alias("fraction"))


#: The update control's constructions, from the edited record's own update to none.
CONSTRUCTIONS = ("superseded", "other_updated", "other_static")


def update_control(df: DataFrame, history: str, condition: str, historical: str, current: str, edited: str, asked: str, value: str, constructions: tuple[str, str, str] = CONSTRUCTIONS) -> DataFrame:
    """history, order (all, aligned or reversed), R of each construction and their three differences, first less second.

    df: a pair's effect per history, construction, both order bits, edited and queried variable (x or z). Aligned orders are those whose bits
    are equal. R is half of (x/x - x/z) + (z/z - z/x), edited/queried, each the mean of its pairs; without one of them it is null, as are its
    differences. Orders and cells are conditional means of one aggregation by history.
    """
    orders = F.array(F.lit("all"), F.when(F.col(historical) == F.col(current), "aligned").otherwise("reversed"))
    long = df.select(history, F.explode(orders).alias("order"), F.col(condition).alias("__c"), F.concat(edited, asked).alias("__cell"), F.col(value).alias("__v"))
    mean = lambda c, cell: F.avg(F.when((F.col("__c") == c) & (F.col("__cell") == cell), F.col("__v")))
    relevance = [(((mean(c, "xx") - mean(c, "xz")) + (mean(c, "zz") - mean(c, "zx"))) / 2).alias(f"R_{c}") for c in constructions]
    found = long.groupBy(history, "order").agg(*relevance)
    a, b, c = constructions
    return found.select("*", *((F.col(f"R_{p}") - F.col(f"R_{q}")).alias(f"{p}_minus_{q}") for p, q in ((a, b), (b, c), (a, c))))
