"""Tables in the roles that the operators need, and a registry of queries with their SQL twins.

lineitem: history = supplier, condition = return flag, member = line status (O is edited), score = mean net price. events: history = user,
family = event type, member = second half of the month, score = mean value. embeddings: eight candidates, the label (mod 8) is the answer.
conversations: versions are turns. Money and effects are rounded to `PLACES` decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL twins of the frames below, as common table expressions.
SQL = {
    "cells": "cells AS (SELECT l_suppkey AS history, l_returnflag AS condition, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS member, avg(l_extendedprice * (1 - l_discount)) AS score, count(*) AS n FROM lineitem GROUP BY ALL)",
    "pairs": "pairs AS (SELECT history, condition, max(CASE WHEN member = 1 THEN score END) - max(CASE WHEN member = 0 THEN score END) AS effect FROM cells GROUP BY ALL)",
    "families": "families AS (SELECT user_id AS history, event_type AS family, CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END AS member, avg(value) AS score FROM events GROUP BY ALL)",
    "family_pairs": "family_pairs AS (SELECT history, family, max(CASE WHEN member = 1 THEN score END) - max(CASE WHEN member = 0 THEN score END) AS effect FROM families GROUP BY ALL)",
    "candidates": "candidates AS (SELECT vec_id, label, CAST(label % 8 AS INTEGER) AS answer, CAST(embedding[1:8] AS DOUBLE[]) AS v FROM embeddings)",
    "turns": "turns AS (SELECT conv_id, turn, role, CAST(length(text) AS DOUBLE) AS size FROM conversations)",
}


def query(sql: str | None = None, uses: str = ""):
    """Register a query by its function's name. uses: names of SQL to put ahead as common table expressions."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ahead = ", ".join(SQL[n] for n in uses.split())
            # a query of its own expressions continues the list after "WITH"
            body = sql.strip()
            ORACLES[f.__name__] = body if not ahead else f"WITH {ahead}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ahead} {body}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, name: str) -> Column:
    return F.round(x, PLACES).alias(name)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history, condition, member, score, n: one shuffle, on the history's cells."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("history"), F.col("l_returnflag").alias("condition"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("member")).agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"), F.count("*").alias("n"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history, condition, effect: edited less baseline."""
    from ..operators.pairs import paired

    return paired(cells(spark, sf_dir), ["history", "condition"], "member", ["score"]).select("history", "condition", (F.col("score_1") - F.col("score_0")).alias("effect"))


def families(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """history, family, member, score, and more aggregates of the cells' events."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("history"), F.col("event_type").alias("family"), F.when(F.dayofmonth("ts") > 15, 1).otherwise(0).alias("member")).agg(F.avg("value").alias("score"), *more)


def family_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pairs import paired

    return paired(families(spark, sf_dir), ["history", "family"], "member", ["score"]).select("history", "family", (F.col("score_1") - F.col("score_0")).alias("effect"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, answer (0-based) and v, eight candidate scores."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("label") % 8).cast("int").alias("answer"), F.slice("embedding", 1, 8).cast("array<double>").alias("v"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("double").alias("size"))
