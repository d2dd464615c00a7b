"""Scores arrive as JSON-lines files and are appended once per example: the streaming form of a resumable scoring loop.

Each micro-batch is a folder of its own under the sink, `batch=<number>`, and so are its rejects. A batch that is run again after a crash
replaces its own folders and compares its records with those of other batches alone, so rows and rejects are those of a run without a
crash, wherever it broke off. No state grows with the stream: the sink is dealt by a hash of the key, and a batch reads the key column of those
parts that its keys fall in. `runs` adds a manifest, a ledger of batches and phases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import Check, enforce
from ..operators.lineage import with_checksum
from ..operators.pinning import pinned

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

PARTS = 64  # of the sink, by a hash of the key


def stream_scores(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stream of score records."""
    return spark.readStream.schema(schema).json(folder)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # the first batch finds no table
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None


def judged(batch: DataFrame, dataset: DataFrame, done: DataFrame | None, number: int, key: str) -> DataFrame:
    """The batch's records with their part of the sink and `reason`: unknown to the dataset, or repeated in this batch or in another one.

    done: the sink; its rows of this batch are an earlier try of it and don't count. Of equal keys in a batch the first by a hash of the record is kept.
    """
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    in_batch = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*batch.columns), F.to_json(F.struct(*batch.columns))))
    rows = pinned(batch.withColumn("part", part).withColumn("__n", in_batch))
    known = dataset.select(key).distinct().withColumn("__known", F.lit(True))
    found = rows.join(known, key, "left")
    if done is None:
        found = found.withColumn("__done", F.lit(None).cast("boolean"))
    else:
        parts = [r[0] for r in rows.select("part").distinct().collect()]  # PARTS at most
        other = done.filter((F.col("batch") != number) & F.col("part").isin(*parts)).select(key).distinct().withColumn("__done", F.lit(True))
        found = found.join(other, key, "left")
    reason = F.when(F.col("__known").isNull(), "unknown").when(F.col("__done").isNotNull() | (F.col("__n") > 1), "repeated")
    return pinned(found.select(*batch.columns, "part", reason.alias("reason")))


def write_rows(rows: DataFrame, out: str, number: int) -> None:
    """The batch's good records, with a checksum for each (over batch and part too, which readers see); an earlier try of the batch is replaced."""
    with_checksum(rows.drop("reason").withColumn("batch", F.lit(int(number)))).drop("batch").write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch={number}")


def write_rejects(rows: DataFrame, out: str, number: int) -> None:
    rows.drop("part").write.mode("overwrite").parquet(f"{out}_rejected/batch={number}")


def append_batch(batch: DataFrame, number: int, dataset: DataFrame, out: str, key: str, strict: bool) -> DataFrame:
    """Write one batch; gives its judged records. If strict, bad ones raise before anything is written."""
    rows = judged(batch, dataset, read_or_none(batch.sparkSession, out), number, key)
    bad = rows.filter("reason is not null")
    if strict:
        enforce([Check("unknown_or_repeated", bad)])
    write_rejects(bad, out, number)
    write_rows(rows.filter("reason is null"), out, number)
    return rows


def append_once(spark: SparkSession, folder: str, schema: str, dataset: DataFrame, out: str, checkpoint: str, key: str = "example_id", strict: bool = False) -> StreamingQuery:
    """Start a query that appends known, new records to `out` (Parquet, with a checksum for each); it stops when the folder's files are read.

    Other records go to `<out>_rejected` with their reason (unknown or repeated); if `strict`, they stop the query before the batch is appended.
    """

    def merge(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, dataset, out, key, strict)

    return stream_scores(spark, folder, schema).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def is_complete(scores: DataFrame, dataset: DataFrame, key: str = "example_id") -> bool:
    """Whether each id of the dataset has its record."""
    return dataset.select(key).join(scores.select(key), key, "left_anti").isEmpty()


def score_with(rows: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """rows through a scorer, a model loaded once per Python worker by its first batch."""
    return rows.mapInPandas(scorer, schema)


def digest_scorer(key: str, labels: list[str]) -> Scorer:
    """A deterministic stand-in for a model: log probabilities from an md5 of the id and label."""
    import hashlib
    import math

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [[int(hashlib.md5(f"{k}:{x}".encode()).hexdigest()[:8], 16) / 2**32 for x in labels] for k in b[key]]
            yield pd.DataFrame({key: b[key], "action_logp": [{x: math.log((v + 0.01) / (sum(r) + 0.01 * len(r))) for x, v in zip(labels, r, strict=True)} for r in raw]})

    return run


def progress(scores: DataFrame, dataset: DataFrame, group: str, key: str = "example_id") -> DataFrame:
    """Scored and expected records by group."""
    found = scores.select(key).distinct().withColumn("__s", F.lit(1))
    return dataset.join(found, key, "left").groupBy(group).agg(F.count("*").alias("expected"), F.count("__s").alias("scored"))
