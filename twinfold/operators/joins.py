"""Joins with contracts: exact one-to-one, complete histories, intersections of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks


def one_to_one(rows: DataFrame, scores: DataFrame, key: str = "example_id", shared: Sequence[str] | None = None) -> DataFrame:
    """rows with their scores; raises unless keys are unique and equal on both sides and all shared columns agree."""
    shared = [c for c in rows.columns if c in scores.columns and c != key] if shared is None else shared
    gaps = checks.coverage(rows, scores, key)
    found = [checks.unique(rows, [key], "duplicate_rows"), checks.unique(scores, [key], "duplicate_scores"), checks.Check("coverage", gaps.filter("missing > 0 or extra > 0"))]
    if shared:
        found.append(checks.Check("metadata", checks.mismatches(rows, scores, key, shared)))
    checks.enforce(found)
    return rows.join(scores.drop(*shared), key)


def one_to_one_by_hash(rows: DataFrame, scores: DataFrame, key: str = "example_id", digest: str = "row_hash") -> DataFrame:
    """As one_to_one, with one digest column in place of column-wise equality."""
    return one_to_one(rows, scores, key, [digest])


def validated_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that raises if a key is repeated on either side."""
    checks.enforce([checks.unique(left, keys, "left_keys"), checks.unique(right, keys, "right_keys")])
    return left.join(right, list(keys), how)


def where_all(df: DataFrame, history: str, holds: Column, unknown: bool = False) -> DataFrame:
    """Rows of histories all of whose rows satisfy a condition. Null counts as false; with `unknown` it counts neither way, as in SQL's bool_and."""
    good = df.groupBy(history).agg(F.bool_and(holds if unknown else F.coalesce(holds, F.lit(False))).alias("__ok")).filter("__ok").select(history)
    return df.join(good, history, "left_semi")


def with_all_cells(df: DataFrame, history: str, cell: str, required: Sequence) -> DataFrame:
    """Rows in the required cells of histories that have every one of them: the intersection of cells."""
    here = df.filter(F.col(cell).isin(*required))
    full = here.groupBy(history).agg(F.count_distinct(cell).alias("__n")).filter(F.col("__n") == len(set(required))).select(history)
    return here.join(full, history, "left_semi")


def with_row_count(df: DataFrame, history: str, expected: int) -> DataFrame:
    """df if each history has the expected number of rows; else raises."""
    checks.enforce([checks.Check("row_count", df.groupBy(history).count().filter(F.col("count") != expected))])
    return df


def metadata_of(df: DataFrame, history: str, columns: Sequence[str]) -> DataFrame:
    """One row per history with columns that must be constant in it."""
    checks.enforce([checks.constant(df, [history], columns)])
    return df.groupBy(history).agg(*(F.any_value(c).alias(c) for c in columns))


def proper_prefixes(candidates: DataFrame, key: str, tokens: str, within: Sequence[str] = ()) -> DataFrame:
    """(shorter, longer) keys where one token list is a proper prefix of another: each list's own prefixes, joined on the whole prefix.

    within: columns in which both must agree. Both sides are sorted: Spark knows lists by their size before prefixes are taken, and would send them all.
    """
    a = candidates.select(*within, F.col(key).alias("shorter"), F.col(tokens).alias("prefix"))
    own = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda n: F.slice(tokens, F.lit(1), n))
    b = candidates.filter(F.size(tokens) > 1).select(*within, F.col(key).alias("longer"), F.explode(own).alias("prefix"))
    return a.join(b.hint("merge"), [*within, "prefix"]).select("shorter", "longer")


def with_legend(df: DataFrame, legend: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of df with the legend's columns (roles, token texts) where it has any; raises if it has a key twice."""
    checks.enforce([checks.unique(legend, keys, "legend_keys")])
    return df.join(legend, list(keys), "left")


def sealed_with(rows: DataFrame, sealed: DataFrame, history: str, expected: int, digest: str, digest_now: str) -> DataFrame:
    """New rows with their history's sealed rows' digest; raises unless each has `expected` sealed rows of one stored digest that is `digest_now`'s."""
    counted = sealed.groupBy(history).agg(F.count("*").alias("__n"), F.count_distinct(digest).alias("__kinds"), F.any_value(digest).alias(digest))
    joined = rows.join(counted, history, "left")
    bad = joined.filter(~F.coalesce((F.col("__n") == expected) & (F.col("__kinds") == 1) & (F.col(digest) == F.col(digest_now)), F.lit(False)))
    checks.enforce([checks.Check("sealed", bad)])
    return joined.drop("__n", "__kinds")


def first_histories(df: DataFrame, history: str, order: str, k: int) -> DataFrame:
    """Rows of the first k histories by the smallest `order` of each (ties by id)."""
    first = df.groupBy(history).agg(F.min(order).alias("__first")).orderBy("__first", history).limit(k).select(history)
    return df.join(first, history, "left_semi")


def first_ids(df: DataFrame, history: str, k: int) -> DataFrame:
    """Rows of the k smallest ids."""
    return df.join(df.select(history).distinct().orderBy(history).limit(k), history, "left_semi")
