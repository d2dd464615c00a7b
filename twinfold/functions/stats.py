"""Order statistics as aggregates. Three trimmed means and three medians exist because reports use all of them; pick by name.

Each aggregate takes a numeric column and ignores nulls. Those built on `collect_list` (trimmed means, upper median, p95) are for the few
rows of a history or cell; `operators.ordered.order_statistics` has the same for groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import let


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _sorted(x: Column) -> Column:
    return F.sort_array(F.collect_list(x.cast("double")))


def trimmed_mean(x: Column, share: float = 0.1) -> Column:
    """Mean without int(share * n) values at either end."""
    return let(_sorted(x), lambda s: let(F.floor(F.size(s) * F.lit(share)).cast("int"), lambda k: _mean(F.slice(s, k + 1, F.size(s) - 2 * k))))


def trimmed_mean_guarded(x: Column, share: float = 0.1) -> Column:
    """As trimmed_mean, but only if more than twice the trimmed values are there; else the plain mean."""
    return let(_sorted(x), lambda s: let(F.floor(F.size(s) * F.lit(share)).cast("int"), lambda k: F.when(F.size(s) > 2 * k, _mean(F.slice(s, k + 1, F.size(s) - 2 * k))).otherwise(_mean(s))))


def trimmed_mean_asymmetric(x: Column, low: float = 0.1, high: float = 0.9) -> Column:
    """Mean of the sorted values from int(low * n) up to ceil(high * n)."""
    return let(_sorted(x), lambda s: let(F.floor(F.size(s) * F.lit(low)).cast("int"), lambda k: _mean(F.slice(s, k + 1, F.ceil(F.size(s) * F.lit(high)).cast("int") - k))))


def upper_median(x: Column) -> Column:
    """The sorted value at n // 2."""
    return let(_sorted(x), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def p95_element(x: Column) -> Column:
    """The sorted value at int(0.95 * (n - 1))."""
    return let(_sorted(x), lambda s: F.get(s, F.floor((F.size(s) - 1) * F.lit(0.95)).cast("int")))


def fraction_positive(x: Column) -> Column:
    return F.avg((x > 0).cast("double"))


def summary(x: Column) -> dict[str, Column]:
    """n, mean, median (interpolated), trimmed mean and fraction positive."""
    return {"n": F.count(x), "mean": F.avg(x), "median": F.median(x), "trimmed": trimmed_mean(x), "fraction_positive": fraction_positive(x)}


def interval_verdict(low: Column, high: Column) -> Column:
    """positive, negative or includes_zero of an interval; null if a bound is."""
    return F.when(low > 0, "positive").when(high < 0, "negative").when(low.isNotNull() & high.isNotNull(), "includes_zero")


def sign_flipped(mean: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """The estimate with its sign turned and its bounds swapped."""
    return -mean, -high, -low
