"""Content hashes of files, tables and stages: what was made from what."""

from __future__ import annotations

import platform
from collections.abc import Sequence
from functools import reduce
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import canonical, native_hash
from ..functions.text import utc_stamp
from .checks import Check, ValidationError, enforce
from .pinning import pinned


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_checksum(df: DataFrame, name: str = "record_sha256") -> DataFrame:
    """df with a checksum over all other columns, in order of their names."""
    return df.withColumn(name, native_hash([F.to_json(F.struct(c)) for c in sorted(df.columns) if c != name]))


def bad_checksums(df: DataFrame, name: str = "record_sha256") -> DataFrame:
    """Rows whose stored checksum isn't that of their columns."""
    now = native_hash([F.to_json(F.struct(c)) for c in sorted(df.columns) if c != name])
    return df.filter(~now.eqNullSafe(F.col(name)))


def seal(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row (rows, seal): a digest of a table, whatever the order and partitioning of its rows.

    Rows' digests are summed modulo 2 ** 128 in four parts, with map-side combining, so no list of them is built. key orders nothing; it
    must be the unique key, so that equal rows cannot hide in the sum.
    """
    row = native_hash([F.to_json(F.struct(*sorted(df.columns)))])
    parts = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    sums = df.agg(F.count("*").alias("rows"), F.count_distinct(*key).alias("keys"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)))
    return sums.select("rows", (F.col("rows") == F.col("keys")).alias("unique"), F.sha2(F.concat_ws(":", "rows", *(F.coalesce(f"s{i}", F.lit(0)) for i in range(4))), 256).alias("seal"))


def verify_stages(stages: DataFrame) -> None:
    """Raise unless each stage (name, ord, input_sha256, output_sha256) takes what the stage before it gave."""
    a, b = stages.alias("a"), stages.alias("b")
    broken = a.join(b, F.col("b.ord") == F.col("a.ord") + 1).filter(~F.col("b.input_sha256").eqNullSafe(F.col("a.output_sha256"))).select("b.name").orderBy("b.ord").collect()
    if broken:
        raise ValidationError("broken lineage at " + ", ".join(r["name"] for r in broken))


def lineage_breaks(stages: DataFrame, edges: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """(stage, fault, parent) of a graph of stages, in which each has any number of parents; no row if all is as recorded.

    stages: stage, sha256 (of its output now). edges: stage, parent, sha256 (of the parent's output when the stage was made). gates: stage, said
    and found (a decision as recorded and as computed again from its rows). Faults: `missing_parent`, `stale_parent` (the parent's output has
    changed since), `cycle` (the stage is its own ancestor), `failed_gate` (found isn't true, or isn't what was said) and `tainted` (parent is
    one whose fault, or taint, comes down this edge). Ancestors are followed by joins in rounds, as many as the graph is deep; a round has
    the edges that aren't settled yet.
    """
    edges = pinned(edges.select("stage", "parent", "sha256").distinct())
    known = stages.select(F.col("stage").alias("parent"), F.col("sha256").alias("__now"), F.lit(True).alias("__known"))
    judged = edges.join(known.hint("merge"), "parent", "left")
    fault = F.when(F.col("__known").isNull(), "missing_parent").when(~F.col("__now").eqNullSafe(F.col("sha256")), "stale_parent")
    found = judged.select("stage", fault.alias("fault"), "parent").filter("fault is not null")
    # what has neither a way in from outside nor out again stays when ends are peeled off: cycles and what stands between two
    ring = edges.select("stage", "parent")
    while True:
        inner = pinned(ring.join(ring.select(F.col("parent").alias("stage")).distinct().hint("merge"), "stage", "left_semi").join(ring.select(F.col("stage").alias("parent")).distinct().hint("merge"), "parent", "left_semi").select("stage", "parent"))
        if inner.count() == ring.count():
            break
        ring = inner
    reach = pinned(ring.select(F.col("stage").alias("a"), F.col("parent").alias("b")).distinct())
    while True:  # ways of up to twice the length
        longer = pinned(reach.unionByName(reach.alias("l").join(reach.alias("r").hint("merge"), F.col("l.b") == F.col("r.a")).select("l.a", "r.b")).distinct())
        if longer.count() == reach.count():
            break
        reach = longer
    found = found.unionByName(reach.filter("a = b").select(F.col("a").alias("stage"), F.lit("cycle").alias("fault"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent")))
    if gates is not None:
        failed = gates.filter(~F.coalesce(F.col("found"), F.lit(False)) | ~F.col("said").eqNullSafe(F.col("found")))
        found = found.unionByName(failed.select("stage", F.lit("failed_gate").alias("fault"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent")))
    found = pinned(found.distinct())
    bad = new = pinned(found.select("stage").distinct())
    taints = []
    while not new.isEmpty():
        down = pinned(edges.select("stage", "parent").join(new.withColumnRenamed("stage", "parent").hint("merge"), "parent").select("stage", F.lit("tainted").alias("fault"), "parent"))
        taints.append(down)
        new = pinned(down.select("stage").distinct().join(bad.hint("merge"), "stage", "left_anti"))
        bad = pinned(bad.unionByName(new))
    return reduce(DataFrame.unionByName, taints, found)


def verify_lineage(stages: DataFrame, edges: DataFrame, gates: DataFrame | None = None) -> None:
    """Raise if lineage_breaks finds a fault."""
    enforce([Check("lineage", lineage_breaks(stages, edges, gates))])


def code_hash(spark: SparkSession, paths: Sequence[str]) -> str:
    """One digest of a list of files: of their canonical {path: sha256} document. Paths are as given."""
    found = {p: file_digests(spark, p).first()["sha256"] for p in paths}  # a project's few files
    return canonical(dict(sorted(found.items())))


def provenance(spark: SparkSession, config: dict, dataset: str | None = None, packages: Sequence[str] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict:
    """What a result was made with: time, settings, the dataset's digest, seed, versions and the session's cluster."""
    versions = {}
    for p in packages:
        try:
            versions[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            versions[p] = None
    return {
        "timestamp_utc": spark.range(1).select(utc_stamp().alias("t")).first()["t"], "config": config, "dataset_sha256": file_digests(spark, dataset).first()["sha256"] if dataset else None, "seed": config.get("seed"),
        "packages": versions, "python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master,
    }
