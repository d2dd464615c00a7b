"""Global running sums, ranks and order statistics without a single task: totals by order-preserving bucket, then sums inside each bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pinning import pinned


def sums_before(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows that come earlier (0 for the first).

    bucket must be monotone in the order. Bucket totals are one row per key and bucket; rows meet only those of their own bucket.
    """
    marked = df.select("*", bucket.alias("__b"), *(c.alias(f"__{n}") for n, c in sums.items()))
    totals = marked.groupBy(*keys, "__b").agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__b", *(F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0)).alias(f"__s_{n}") for n in sums))
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(starts, [*keys, "__b"])
    return joined.select(*df.columns, *((F.col(f"__s_{n}") + F.coalesce(F.sum(f"__{n}").over(within), F.lit(0))).alias(n) for n in sums))


BUCKETS = 512


def with_bucket(df: DataFrame, keys: Sequence[str], column: str, name: str = "bucket") -> DataFrame:
    """df with a number or text that is monotone in a column within each key, for `sums_before`.

    Numbers: their place on a scale around the key's approximate median, in units of its quartiles' distance. Others: the first three
    characters behind the beginning that all values share. The facts are one row per key.
    """
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.NumericType):
        x = c.cast("double")
        q = F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000)
        facts = df.groupBy(*keys).agg(q.alias("__q"))
        z = (x - F.get("__q", 1)) / F.greatest(F.get("__q", 2) - F.get("__q", 0), F.abs(F.get("__q", 1)) * 1e-9 + 1e-300)
        place = F.floor(z / (1 + F.abs(z)) * BUCKETS)
    else:
        x = c.cast("string")
        low, high = F.min(x).alias("__low"), F.max(x).alias("__high")
        facts = df.groupBy(*keys).agg(low, high)
        shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length("__low"), F.length("__high"))), lambda k: F.left("__low", k) == F.left("__high", k))) - 1
        place = F.substring(x, shared + 1, F.lit(3))
    if not keys:
        return df.crossJoin(F.broadcast(facts)).select(*df.columns, place.alias(name))  # one row
    facts = facts.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return df.join(facts, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], "left").select(*df.columns, place.alias(name))


def with_range(df: DataFrame, keys: Sequence[str], column: str, name: str = "bucket") -> DataFrame:
    """df with a number that is monotone in a column within each key, for `sums_before`: its rows' range of (keys, column).

    The ranges are Spark's, taken from a sample of the rows, so there are as many as partitions and a hot key has several; only rows of
    one value can't be parted. They are drawn once: the rows are pinned.
    """
    return pinned(df.repartitionByRange(*keys, column).withColumn(name, F.spark_partition_id()))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n (rows of this value), below (rows of smaller ones), total: values are counted first, so a hot value is one row."""
    counted = with_range(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value, "__place")
    ranked = sums_before(counted, keys, F.col("__place"), [F.col(value)], {"below": F.col("n")}).drop("__place")
    total = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    return ranked.join(total, list(keys)) if keys else ranked.crossJoin(F.broadcast(total))


def between_ranks(low: Column, high: Column, value: str) -> Column:
    """Aggregate over value_ranks: the mean of the sorted values from rank low up to high (not included)."""
    inside = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), high) - F.greatest(F.col("below"), low))
    return F.try_divide(F.sum(F.col(value) * inside), F.sum(inside))


def at_rank(rank: Column, value: str) -> Column:
    """Aggregate over value_ranks: the sorted value at a rank (from 0)."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(value)))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.1) -> DataFrame:
    """keys, n, trimmed (int(share n) off both ends), trimmed_guarded (the mean if that leaves nothing), trimmed_asymmetric (from
    int(share n) up to ceil((1 - share) n)), upper_median (at n // 2), p95 (at int(0.95 (n - 1))): for groups of any size."""
    t = F.col("total")
    cut = F.floor(t * F.lit(share))
    trimmed = between_ranks(cut, t - cut, value)
    mean = F.sum(F.col(value) * F.col("n")) / F.sum("n")
    found = value_ranks(df, keys, value).groupBy(*keys).agg(
        F.sum("n").alias("n"), trimmed.alias("trimmed"), F.coalesce(trimmed, mean).alias("trimmed_guarded"), between_ranks(cut, F.ceil(t * F.lit(1 - share)), value).alias("trimmed_asymmetric"),
        at_rank(F.floor(t / 2), value).alias("upper_median"), at_rank(F.floor((t - 1) * F.lit(0.95)), value).alias("p95"),
    )
    return found
