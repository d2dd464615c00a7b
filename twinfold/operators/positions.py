"""Effects by absolute position in their long form: paired by position, with the roles that each query gives it, then by role.

Rows are measurements: history, layer, position, query (one of two), role, effect, and for the legend a token's text. Two queries may give one
position different roles and tokens, so these take no part in the pairing; roles are split only after it. Each step is one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role of a position that has none.
OTHER = "other_position"


def _texts(query: str, name: str, column: str) -> Column:
    """The sorted distinct values of a column in one query's rows; nulls left out."""
    return F.sort_array(F.collect_set(F.when(F.col("query") == query, F.col(column))))


def paired_positions(rows: DataFrame, keys: Sequence[str], queries: tuple[str, str]) -> DataFrame:
    """keys, position, effect_<query> (means over rows), difference (first less second; null unless both are there), roles_<query> (arrays)."""
    a, b = queries
    mean = lambda q: F.avg(F.when(F.col("query") == q, F.col("effect")))
    found = rows.filter(F.col("query").isin(a, b)).groupBy(*keys, "position").agg(*(mean(q).alias(f"effect_{q}") for q in queries), *(_texts(q, "roles", "role").alias(f"roles_{q}") for q in queries))
    return found.withColumn("difference", F.col(f"effect_{a}") - F.col(f"effect_{b}"))


def split_roles(paired: DataFrame, keys: Sequence[str], queries: tuple[str, str]) -> DataFrame:
    """keys, position, role, difference: a row for each role that either query gives the position, once; positions of no role have none."""
    roles = F.array_except(F.array_union(*(F.col(f"roles_{q}") for q in queries)), F.array(F.lit(OTHER)))
    return paired.select(*keys, "position", "difference", F.explode(roles).alias("role"))


def by_role(split: DataFrame, history: str, keys: Sequence[str]) -> DataFrame:
    """keys, role, mean, median and n of histories: positions are averaged within a history first."""
    own = split.groupBy(history, *keys, "role").agg(F.avg("difference").alias("m"))
    return own.groupBy(*keys, "role").agg(F.avg("m").alias("mean"), F.median("m").alias("median"), F.count("m").alias("n"))


def role_places(split: DataFrame, history: str) -> DataFrame:
    """role, histories, least, most and positions: how far a role moves over absolute positions."""
    return split.groupBy("role").agg(F.count_distinct(history).alias("histories"), F.min("position").alias("least"), F.max("position").alias("most"), F.count_distinct("position").alias("positions"))


def position_summary(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, position, mean and n (histories with both queries)."""
    return paired.groupBy(*keys, "position").agg(F.avg("difference").alias("mean"), F.count("difference").alias("n"))


def legend(rows: DataFrame, queries: tuple[str, str], regions: Mapping[str, str], unknown: str = "rendered_text_unclassified") -> DataFrame:
    """position, token_text_<query> and roles_<query> (joined by " | "; null where the query lacks the position), role and region.

    role: all roles of either query, or OTHER; region: theirs by `regions`, `unknown` for those that it lacks and for a position of no role.
    """
    found = rows.filter(F.col("query").isin(*queries)).groupBy("position").agg(*(_texts(q, "t", "token_text").alias(f"t_{q}") for q in queries), *(_texts(q, "r", "role").alias(f"r_{q}") for q in queries))
    roles = F.array_sort(F.array_except(F.array_union(*(F.col(f"r_{q}") for q in queries)), F.array(F.lit(OTHER))))
    named = F.create_map(*(F.lit(x) for kv in regions.items() for x in kv)) if regions else F.create_map().cast("map<string,string>")
    region = F.array_sort(F.array_distinct(F.transform(roles, lambda r: F.coalesce(F.try_element_at(named, r), F.lit(unknown)))))
    joined = lambda x: F.array_join(x, " | ")
    shown = lambda x: F.when(F.size(x) > 0, joined(x))
    return found.select(
        "position", *(shown(F.col(f"t_{q}")).alias(f"token_text_{q}") for q in queries), *(shown(F.col(f"r_{q}")).alias(f"roles_{q}") for q in queries),
        F.coalesce(shown(roles), F.lit(OTHER)).alias("role"), F.coalesce(shown(region), F.lit(unknown)).alias("region"),
    )
