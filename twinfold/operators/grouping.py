"""Groupings beyond one key: two-level rates, several keys at once, overlapping memberships, distinct prompts, top-k, transitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def two_level_mean(df: DataFrame, group: Sequence[str], history: str, value: str) -> DataFrame:
    """Mean over histories of each history's own mean."""
    return df.groupBy(*group, history).agg(F.avg(value).alias("__m")).groupBy(*group).agg(F.count("*").alias("histories"), F.avg("__m").alias(value))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """One row per group of each key set; keys outside a set are null, and `level` names the set (`all` for the empty one)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    level = F.concat_ws(",", *(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates, F.when(level == "", "all").otherwise(level).alias("level"))


def overlapping(df: DataFrame, members: str, name: str) -> DataFrame:
    """A row for each distinct member of an array: groups that share rows."""
    return df.withColumn(name, F.explode(F.array_distinct(members)))


def distinct_prompts(df: DataFrame, keys: Sequence[str], diagnostics: Sequence[str]) -> DataFrame:
    """One row per key; raises if a prompt's diagnostics disagree between its rows."""
    from . import checks

    checks.enforce([checks.constant(df, keys, diagnostics)])
    return df.groupBy(*keys).agg(*(F.any_value(d).alias(d) for d in diagnostics))


def top_k(df: DataFrame, keys: Sequence[str], item: str, order: str, k: int) -> DataFrame:
    """The k most frequent items of each key; ties go to the item seen first."""
    counted = df.groupBy(*keys, item).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    by = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first_seen", item)
    return counted.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def transitions(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Counts of ordered category changes."""
    return df.groupBy(*keys, before, after).agg(F.count("*").alias("n"))


def struct_means(df: DataFrame, keys: Sequence[str], column: str, fields: Mapping[str, str]) -> DataFrame:
    """Means of fields of a list of structs (or of one struct): name -> field."""
    several = isinstance(df.schema[column].dataType, T.ArrayType)
    each = df.select(*keys, F.explode(column).alias("__s") if several else F.col(column).alias("__s"))
    return each.groupBy(*keys).agg(*(F.avg(F.col(f"__s.{f}").cast("double")).alias(n) for n, f in fields.items()))


def lowest_group(df: DataFrame, group: str, rate: str) -> DataFrame:
    """The group of the smallest rate; the first name on a tie."""
    return df.agg(F.min(F.struct(F.col(rate).alias("r"), F.col(group).alias("g"))).alias("x")).select(F.col("x.g").alias(group), F.col("x.r").alias(rate))


def ratio_of_means(df: DataFrame, group: Sequence[str], numerator: str, denominator: str, least: float) -> DataFrame:
    """Mean numerator by mean denominator, null unless the denominator exceeds `least`. Never a mean of ratios."""
    a, b = F.avg(numerator), F.avg(denominator)
    return df.groupBy(*group).agg(a.alias("numerator"), b.alias("denominator"), F.when(b > least, a / b).alias("ratio"))


def gpu_hours(timings: DataFrame, group: Sequence[str], seconds: str = "seconds") -> DataFrame:
    return timings.groupBy(*group).agg((F.sum(seconds) / 3600).alias("hours"))


def trace_numbers(numbers: DataFrame, literals: DataFrame) -> DataFrame:
    """literals (text) with the paths of numbers (path, value) that round to them at their decimals, also as percentages of [0, 1] values.

    Values are rounded half-even at each number of decimals that a literal has, so the match is an equi-join on (decimals, rounded).
    """
    decimals = F.coalesce(F.length(F.nullif(F.regexp_extract("text", r"\.(\d+)$", 1), F.lit(""))), F.lit(0))
    asked = literals.select("text", decimals.alias("d"), F.col("text").cast("double").alias("key"))
    forms = numbers.select("path", F.explode(F.array(F.col("value"), F.when(F.col("value").between(0, 1), F.col("value") * 100))).alias("v")).filter("v is not null")
    steps = sorted(r[0] for r in asked.select("d").distinct().collect())  # the few numbers of decimals
    keys = F.array(*(F.struct(F.lit(k).alias("d"), F.bround("v", k).alias("key")) for k in steps)) if steps else F.array().cast("array<struct<d:int,key:double>>")
    rounded = forms.select("path", F.explode(keys).alias("x")).select("path", "x.d", (F.col("x.key") + 0.0).alias("key"))  # no negative zero
    return asked.join(rounded, ["d", "key"], "left").groupBy("text").agg(F.sort_array(F.collect_set("path")).alias("paths"))
