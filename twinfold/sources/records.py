"""JSON lines, bundles, CSV and tensors in; canonical files, Markdown and LaTeX out.

Data go in and out through Spark's own readers and writers, so any Hadoop file system serves; only reports (a bounded summary) and
configurations pass through the driver. Schemas are given, never inferred.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stripped
from ..operators.ordered import sums_before, with_bucket, with_range


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped; a malformed or truncated one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_line_numbers(df: DataFrame, order: str = "ord") -> DataFrame:
    """df with increasing numbers in file order. They are gapless only within a file split; order is what statistics need."""
    return df.withColumn(order, F.monotonically_increasing_id())


def write_jsonl(df: DataFrame, path: str, exclusive: bool = True, order: str | None = None) -> None:
    """JSON lines with sorted keys; an existing path raises unless told otherwise. Non-finite numbers raise.

    order: write one file in the order of this column, the canonical form of a table that one task can write; else a file for each partition.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    checked = df
    for c in doubles:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        checked = checked.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)))
    checked = checked if order is None else checked.coalesce(1).sortWithinPartitions(order)
    checked.select(*sorted(df.columns)).write.mode("errorifexists" if exclusive else "overwrite").option("ignoreNullFields", "false").json(path)


def read_bundle(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a .jsonl file, or of the `rows` list of a .json document."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    row = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    whole = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(row))])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode("rows").alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_by_suffix(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV or JSON lines by the path's ending."""
    return read_csv(spark, path, schema) if path.endswith(".csv") else read_bundle(spark, path, schema)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON document of settings, or a YAML one where PyYAML is installed (a few KB, on the driver)."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise NotImplementedError("YAML settings need PyYAML; JSON ones don't") from e
    return yaml.safe_load(text)


def read_tensors(spark: SparkSession, paths: str | list[str], key: str) -> DataFrame:
    """(path, row, vector) of one array of NPZ chunks; a chunk is one task's batch and rows keep their place within it."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                x = np.load(io.BytesIO(content))[key].astype(np.float32)
                yield pd.DataFrame({"path": path, "row": np.arange(len(x)), "vector": list(x.reshape(len(x), -1))})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, row long, vector array<float>")


def aligned_tensors(tensors: DataFrame, expected: int) -> DataFrame:
    """Rows of read_tensors with `ord`, their place over all chunks in order of the chunks' names; raises unless there are `expected` of them.

    The offsets are sums over one row a chunk.
    """
    chunks = tensors.groupBy("path").agg(F.count("*").alias("n"))
    placed = sums_before(with_bucket(chunks, [], "path", "__place"), [], F.col("__place"), [F.col("path")], {"offset": F.col("n")})
    found = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if found != expected:
        raise ValueError(f"{found} activation rows for {expected} records")
    return tensors.join(placed.select("path", "offset"), "path").select("path", "row", (F.col("offset") + F.col("row")).alias("ord"), "vector")


def discover(spark: SparkSession, folder: str, allow: Sequence[str], deny: Sequence[str] = ()) -> DataFrame:
    """(path, length) of files under a folder whose names have an allowed word and no denied one; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.lower(F.substring_index("path", "/", -1))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    return files.filter(has(allow) & (~has(deny) if deny else F.lit(True))).orderBy("path")


def first_records(spark: SparkSession, folder: str, schema: str | T.StructType, allow: Sequence[str], deny: Sequence[str] = ()) -> DataFrame:
    """(path, fields of schema) of the first record of each .jsonl file, and of each .json bundle's rows, among what `discover` finds.

    For discovery by content: a filter on the fields tells which files hold what is sought. A file without a record has nulls. Lines are read
    where they lie, and one per file and task is shuffled; a first record that doesn't parse raises.
    """
    row = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    meta, name = F.col("_metadata"), F.lower(F.col("_metadata.file_name"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    wanted = has(allow) & (~has(deny) if deny else F.lit(True))
    reader = lambda ending: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ending)
    lines = reader("*.jsonl").option("lineSep", "\n").text(folder).filter(wanted)
    placed = lines.select(meta["file_path"].alias("path"), F.struct(meta["file_block_start"], F.monotonically_increasing_id()).alias("place"), F.when(F.trim("value") != "", F.col("value")).alias("value"))
    first = placed.groupBy("path").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("place"))).alias("value"))
    of_lines = first.select("path", F.from_json("value", row, {"mode": "FAILFAST"}).alias("r"))
    bundles = reader("*.json").schema(T.StructType([T.StructField("rows", T.ArrayType(row))])).option("multiLine", True).option("mode", "FAILFAST").json(folder).filter(wanted)
    return of_lines.unionByName(bundles.select(meta["file_path"].alias("path"), F.get("rows", 0).alias("r"))).select("path", "r.*")


def complete_units(lines: DataFrame, key: str, expected: Column) -> DataFrame:
    """Rows of units whose marker count equals their row count; a truncated unit's rows go, whole units stay.

    lines: unit rows with a column that is the number of rows which the unit says it has (null in rows without a marker).
    """
    found = lines.groupBy(key).agg(F.max(expected).alias("__said"), F.count("*").alias("__rows")).filter(F.col("__said") == F.col("__rows")).select(key)
    return lines.join(found.hint("merge"), key, "left_semi")  # units grow with the lines: they are never sent to all tasks


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size, block, place, value) of all lines: their file, its bytes, the start of their split of it, increasing numbers, and the line.

    Lines end at "\\n" alone, so a line's bytes and one more are what it takes of its file; block and place order a file's lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    return lines.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def open_tails(lines: DataFrame) -> DataFrame:
    """(path, block, place, offset, value) of the files of `file_lines` whose last line has no line end: the bytes behind the last one.

    A file's lines with one byte each for their ends make one byte more than the file has. One row per file and task is shuffled.
    """
    last = F.max_by(F.struct("block", "place", "value"), F.struct("block", "place")).alias("last")
    files = lines.groupBy("path").agg(F.max("size").alias("size"), F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("taken"), last)
    return files.filter("taken = size + 1").select("path", "last.block", "last.place", (F.col("size") - F.octet_length("last.value")).alias("offset"), "last.value")


def recover_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, tails): what an interrupted writer left behind a file's last line end is set aside, even if it parses.

    tails: path, offset (its first byte's place), length, sha256, value and bytes of each file's fragment, nothing changed. Every line with an end
    is a record: one that doesn't parse raises, wherever it stands; blank ones are skipped.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = file_lines(spark, path)
    tails = open_tails(lines)
    ended = lines.join(tails.select("path", "block", "place"), ["path", "block", "place"], "left_anti").filter(F.trim("value") != "")
    records = ended.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    raw = F.col("value").cast("binary")
    return records, tails.select("path", "offset", F.octet_length("value").cast("long").alias("length"), F.sha2(raw, 256).alias("sha256"), "value", raw.alias("bytes"))


def text_tail(text: Column) -> Column:
    """Of a text: struct(offset, length, sha256) of the bytes behind its last line end; null where there are none."""
    tail = F.substring_index(text, "\n", -1)
    n = F.octet_length(tail).cast("long")
    return F.when(n > 0, F.struct((F.octet_length(text) - n).alias("offset"), n.alias("length"), F.sha2(tail.cast("binary"), 256).alias("sha256")))


def flatten_json(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, path, value) of all numbers in JSON texts, as dotted paths; malformed texts raise, null ones have none.

    Texts become variants, which are exploded level by level as deep as any of them goes.
    """
    spark = df.sparkSession
    level = df.select(*keep, F.lit("").alias("__path"), F.parse_json(text).alias("__v"))
    kind = F.regexp_extract(F.schema_of_variant("__v"), r"^\w+", 0)
    number = F.try_variant_get("__v", "$", "double")
    numeric = kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    nested = kind.isin("OBJECT", "ARRAY")
    found = [level.filter(numeric).select(*keep, F.col("__path").alias("path"), number.alias("value"))]
    while True:
        level = level.filter(nested)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = level.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        path = F.when(F.col("key").isNull(), F.concat("__path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("__path") == "", F.col("key")).otherwise(F.concat_ws(".", "__path", "key"))
        level = rows.select(*keep, path.alias("__path"), F.col("value").alias("__v"))
        found.append(level.filter(numeric).select(*keep, F.col("__path").alias("path"), number.alias("value")))


def plan_blocks(lines: DataFrame, order: str = "ord", text: str = "line", fields: Sequence[str] = ("status", "owner", "claimed_at", "deps", "source", "done-when")) -> DataFrame:
    """(id, ord, each field, deps as an array) of a Markdown plan: blocks begin with "### id", fields are "- name: value" lines; the last of a name counts.

    Lines are numbered by `order`; a line belongs to the last header before it, found by a running count over ranges of the order.
    """
    header = F.regexp_extract(text, r"^### +(\S+)\b", 1)
    field = [F.regexp_extract(text, r"^- (" + "|".join(fields) + r"):\s*(.*)$", i) for i in (1, 2)]
    marked = lines.select(order, F.nullif(header, F.lit("")).alias("id"), F.nullif(field[0], F.lit("")).alias("field"), stripped(field[1]).alias("value"))
    placed = with_range(marked.filter("id is not null or field is not null"), [], order, "__place")
    counted = sums_before(placed, [], F.col("__place"), [F.col(order)], {"__before": F.col("id").isNotNull().cast("long")})
    block = F.col("__before") + F.col("id").isNotNull().cast("long")
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col(order)))
    found = counted.withColumn("__block", block).filter("__block > 0").groupBy("__block").agg(F.max("id").alias("id"), F.min(order).alias(order), *(last(f).alias(f) for f in fields))
    deps = F.filter(F.split(F.coalesce("deps", F.lit("")), r"[,\s]+"), lambda d: ~d.isin("", "—", "-"))
    return found.drop("__block").withColumn("deps", deps)


def to_markdown(summary: DataFrame, decimals: int = 3) -> str:
    """A bounded summary as a Markdown table."""
    return _table(summary, decimals, "| ", " | ", " |", "|" + "---|" * len(summary.columns))


def to_latex(summary: DataFrame, decimals: int = 3) -> str:
    """A bounded summary as LaTeX rows."""
    return _table(summary, decimals, "", " & ", r" \\", r"\midrule")


def _table(summary: DataFrame, decimals: int, start: str, between: str, end: str, rule: str) -> str:
    marks = {"|": "\\|"} if start else {c: "\\" + c for c in "&%$#_{}"}  # what would end a cell or begin a command
    plain = str.maketrans(marks | {"\n": " "})
    show = lambda x: "" if x is None else f"{x:.{decimals}f}" if isinstance(x, float) else str(x).translate(plain)
    head, *rows = [start + between.join(map(show, r)) + end for r in [summary.columns, *summary.collect()]]
    return "\n".join([head, rule, *rows])
