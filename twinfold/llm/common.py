"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.pinning import pinned, shared_checkpoints

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "WORD", "as_bytes", "chunks", "fresh", "hint_small", "mapped", "mix64", "pinned", "shared_checkpoints", "table", "unsigned"]

#: ASCII white space, the complement of the word class [^\x20\x09-\x0D]; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with bounded memory: small batches, and workers that give back what a task leaves free.

    Workers live on from stage to stage; what their allocators hold would stay with each executor. The session's batch settings are kept
    where they are smaller than these.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub(r"\D", "", conf.get(name)) or "0"
        if not 0 < int(now) <= most:
            conf.set(name, str(most))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Free pages of this process's allocators go back to the machine (glibc; elsewhere only Arrow's)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hint_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise Spark is left to choose another join."""
    return F.broadcast(df) if rows <= limit else df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that no column has, whatever its case."""
    lower = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about `most` bytes each (a longer text is a range of its own)."""
    start = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


def unsigned(seed: str, *parts) -> int:
    """A stable 63-bit seed."""
    import zlib

    text = "|".join(map(str, (seed, *parts))).encode()
    return (zlib.crc32(text) << 31) ^ zlib.adler32(text[::-1])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 (splitmix64's published constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
