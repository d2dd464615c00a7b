"""Fail-closed validation: every rule is a frame of violations, all are counted in one job, and any violation raises."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Raised with the names and counts of violated checks."""


@dataclass(frozen=True)
class Check:
    name: str
    violations: DataFrame


def counts(checks: Sequence[Check]) -> DataFrame:
    """(check, violations) of each check, in one plan."""
    parts = [c.violations.agg(F.count("*").alias("violations")).select(F.lit(c.name).alias("check"), "violations") for c in checks]
    return reduce(DataFrame.unionByName, parts)


def enforce(checks: Sequence[Check]) -> None:
    """Raise if any check has a violation. One action for all of them."""
    bad = counts(checks).filter("violations > 0").orderBy("check").collect()
    if bad:
        raise ValidationError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def not_empty(df: DataFrame) -> Check:
    return Check("not_empty", df.agg(F.count("*").alias("n")).filter("n = 0"))


def unique(df: DataFrame, keys: Sequence[str], name: str = "unique") -> Check:
    """Keys that stand in several rows."""
    return Check(name, df.groupBy(*keys).count().filter("count > 1"))


def constant(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> Check:
    """Groups in which a column has several values (null is a value)."""
    hashed = [F.count_distinct(F.struct(c)).alias(f"__n{i}") for i, c in enumerate(columns)]
    return Check("constant", df.groupBy(*group).agg(*hashed).filter(reduce(lambda a, b: a | b, (F.col(f"__n{i}") > 1 for i in range(len(columns))))))


def one_value(df: DataFrame, column: str) -> Check:
    """A column that must have one value over all rows."""
    return Check(f"one_{column}", df.agg(F.count_distinct(F.struct(column)).alias("n")).filter("n > 1"))


def member_of(df: DataFrame, column: str, allowed: Sequence) -> Check:
    return Check(f"enum_{column}", df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))))


def rule(df: DataFrame, name: str, holds: Column) -> Check:
    """Rows where a condition is false or null."""
    return Check(name, df.filter(~F.coalesce(holds, F.lit(False))))


def finite_map(df: DataFrame, column: str, keys: Column) -> Check:
    """Rows whose score map hasn't exactly these keys, or holds a null, NaN or infinite score."""
    values = F.map_values(column)
    ok = (F.sort_array(F.map_keys(column)) == F.sort_array(keys)) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rule(df, f"finite_{column}", ok)


def forbidden_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise if a column stands there that a gate must not see."""
    if found := sorted({*df.columns} & {*names}):
        raise ValidationError(f"forbidden columns: {', '.join(found)}")


def missing_cells(df: DataFrame, history: str, cells: Sequence[str]) -> DataFrame:
    """(history, cell) that a complete design would have and df hasn't: all histories by all cells that occur anywhere.

    The design is one row per distinct cell: a constant of the protocol, sent to the histories rather than joined by a shuffle.
    """
    design = df.select(*cells).distinct()
    wanted = df.select(history).distinct().crossJoin(F.broadcast(design))
    return wanted.join(df.select(history, *cells).distinct(), [history, *cells], "left_anti")


def complete(df: DataFrame, history: str, cells: Sequence[str]) -> list[Check]:
    return [Check("missing_cells", missing_cells(df, history, cells)), unique(df, [history, *cells], "duplicate_cells")]


def balanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(least, most) rows of a cell: equal in a balanced design."""
    return df.groupBy(*columns).count().agg(F.min("count").alias("least"), F.max("count").alias("most"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(missing, extra): keys of left that right lacks, and the reverse, null keys included."""
    a, b = left.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(1)), right.select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(1))
    joined = a.alias("a").join(b.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")), "full_outer")
    return joined.agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, violations): rows of equal key whose shared columns differ (null equals null; maps as sorted entries)."""
    kinds = dict(left.dtypes)
    value = lambda side, c: F.sort_array(F.map_entries(F.col(f"{side}.{c}"))) if kinds[c].startswith("map") else F.col(f"{side}.{c}")
    joined = left.alias("a").join(right.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    flags = F.array(*(F.when(~value("a", c).eqNullSafe(value("b", c)), F.lit(c)) for c in columns))
    return joined.select(F.explode(flags).alias("column")).filter("column is not null").groupBy("column").agg(F.count("*").alias("violations"))


def overlap(left: DataFrame, right: DataFrame, signature: str) -> DataFrame:
    """Signatures that stand on both sides; must be empty for disjoint splits."""
    return left.select(signature).distinct().join(right.select(signature).distinct(), signature, "left_semi")
