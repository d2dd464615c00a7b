"""Mixing sources to target weights by pivotal dependent rounding.

A source that shall give a share f of its words gives each document floor(f) whole copies and one more with probability f - floor(f).
The fractional copies are rounded dependently: two documents meet, and word mass moves at random from one to the other until one of
them has none or a whole copy; the move's odds keep each document's expectation, and the source's words stay the same. Leaf groups of a
source (salted, about LEAF documents each) leave at most one fractional document; these residuals meet in groups of FAN, level by
level, until one per source is left, which is rounded by a coin. So a source misses its target by less than one document.

Nulls: a null source is a source of its own, last in order; null text has size 0 and takes nothing. Repeated rows and ids are mixed one by
one: rows are known by their number in the table. Seeds come from the source, level and group, and ties are ordered, so reruns over a table
agree. Very long texts are ordinary rows of many words. Only the named columns are read; all others are carried along. Empty tables give
empty results.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sums_before, with_bucket
from .common import WORD, fresh, hint_small, pinned, unsigned

LEAF, FAN, MOST = 2000, 200, 3.0
_LEVEL = "row_no long, doc_id {id}, size long, source_no int, whole int, p double, open boolean"


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """source, source_no (by code point, null last), source_size and target for a table of (source, size) rows.

    Targets share all words by weight, repeated over the sources; one above `most` times its source stops there and the excess is shared
    again. In the order of most * source_size / weight the stopped sources come first, so running sums find them. Numbers and sums go by
    buckets, so sources may be many (domains, say).
    """
    base = pinned(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    named = with_bucket(base.filter("source is not null"), [], "source", "place")
    numbered = sums_before(named, [], F.col("place"), [F.col("source")], {"source_no": F.lit(1)}).drop("place")
    n = base.agg(F.count("source").alias("source_no"))  # one row
    numbered = numbered.unionByName(base.filter("source is null").crossJoin(F.broadcast(n))).withColumn("source_no", F.col("source_no").cast("int"))
    numbered = pinned(numbered)
    weighted = numbered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    ahead = sums_before(with_bucket(weighted, [], "ratio", "place"), [], F.col("place"), [F.col("ratio"), F.col("source_no")], {"cap_ahead": F.col("cap"), "w_ahead": F.col("w")})
    whole = weighted.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))  # one row
    level = (F.col("all_size") - F.col("cap_ahead")) / (F.col("all_w") - F.col("w_ahead"))
    # a source stops if, with all before it stopped, its share by weight is still above its cap; from the first that doesn't, all share alike
    found = ahead.crossJoin(F.broadcast(whole)).withColumn("level", level).withColumn("stops", F.col("level") * F.col("w") > F.col("cap"))
    first = found.agg(F.min(F.when(~F.col("stops"), F.struct("ratio", "source_no", "level")))["level"].alias("free"))  # one row
    target = F.coalesce(F.least(F.col("cap"), F.col("free") * F.col("w")), F.col("cap"))
    return found.crossJoin(F.broadcast(first)).select("source", "source_no", "source_size", "n_docs", target.alias("target"))


def round_group(rows: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Pivotal rounding of rows (size, p): p becomes 0 or 1 for all but at most one row, for all if it is the last group of its source."""
    rows = rows.sort_values(["size", "doc_id", "row_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, p, rng = rows["size"].to_numpy(float), rows["p"].to_numpy(float).copy(), random.Random(seed)
    tiny, i = 1e-12, -1
    for j in range(len(rows)):
        if not tiny < p[j] < 1 - tiny:
            continue
        if i < 0:
            i = j
            continue
        a, b = p[i] * size[i], p[j] * size[j]
        out, back = min(a, size[j] - b), min(b, size[i] - a)
        move = out if rng.random() * (out + back) < back else -back
        p[i], p[j] = (a - move) / size[i], (b + move) / size[j]
        if not tiny < p[i] < 1 - tiny:
            i = j if tiny < p[j] < 1 - tiny else -1
    if last and i >= 0:
        p[i] = float(rng.random() < p[i])
    is_open = (p > tiny) & (p < 1 - tiny)
    rows["p"], rows["open"] = p.round(12) * is_open + (p > 0.5) * ~is_open, is_open
    return rows


def mix(documents: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = MOST, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, row_no (the row's number in the table), source, size, source_size, target and copies (whole) of each row."""
    spark = documents.sparkSession
    sized = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = pinned(sized.withColumn("row_no", F.monotonically_increasing_id()))  # pinned: the numbers stay
    sources = pinned(targets(sized, weights, most))
    top = sources.agg(F.max("n_docs"), F.count("*")).first()
    here = hint_small(sources, top[1])
    share = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    # a source's share just below a whole number is that number: floating point must not round a copy away
    near = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    key = [F.col("s.source").eqNullSafe(F.col("d.source"))]
    rows = sized.alias("d").join(here.alias("s"), key).select("d.row_no", "d.doc_id", "d.size", "s.source", "s.source_no", "s.source_size", "s.n_docs", "s.target", F.when(F.col("d.size") > 0, F.coalesce(near, F.lit(0.0))).otherwise(0.0).alias("f"))
    rows = rows.withColumn("whole", F.floor("f").cast("int")).withColumn("p", F.col("f") - F.floor("f"))
    kind = sized.schema["doc_id"].dataType.simpleString()
    schema = _LEVEL.format(id=kind)
    leaf = F.pmod(F.xxhash64("row_no"), F.ceil(F.col("n_docs") / LEAF)).cast("int")
    begin = rows.filter("p > 0").select("row_no", "doc_id", "size", "source_no", "whole", "p", leaf.alias("part"))

    def level(df: DataFrame, k: int, last: bool) -> DataFrame:
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            out = round_group(group, unsigned(seed, k, *key), last)
            return out[["row_no", "doc_id", "size", "source_no", "whole", "p", "open"]]

        return pinned(df.groupBy("source_no", "part").applyInPandas(run, schema))

    parts, k, done = -(-(top[0] or 0) // LEAF), 0, []
    while True:
        now = level(begin, k, parts <= 1)
        done.append(now.filter("not open"))
        if parts <= 1:
            break
        parts, k = -(-parts // FAN), k + 1
        begin = now.filter("open").select("row_no", "doc_id", "size", "source_no", "whole", "p", F.pmod(F.xxhash64("row_no", F.lit(k)), F.lit(parts)).cast("int").alias("part"))
    rounded = done[0]
    for x in done[1:]:
        rounded = rounded.unionByName(x)
    facts = hint_small(sources, top[1])
    fixed = rows.filter("p = 0").select("row_no", "doc_id", "size", "source_no", F.col("whole").alias("copies"))
    settled = fixed.unionByName(rounded.select("row_no", "doc_id", "size", "source_no", (F.col("whole") + F.col("p").cast("int")).alias("copies")))
    return settled.join(facts, "source_no").select("doc_id", "row_no", "source", "size", "source_size", "target", "copies")


def mixture(documents: DataFrame) -> DataFrame:
    """The contract's columns: taken counts a document's words with repeats."""
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of documents, each as often as the mix takes it. Columns of any name are carried along as they are.

    Rows are known by their number in the table, so repeated rows and ids are safe. documents is read twice and must come in the same order
    both times (a table, or a checkpoint); a row that isn't where it was raises.
    """
    number, copies, copy, row, i = fresh(documents.columns, "number", "copies", "copy", "of_row", "of_id")
    mixed = pinned(mix(documents, text=text, doc_id=doc_id, **options).select(F.col("row_no").alias(row), F.col("doc_id").alias(i), F.col("copies").alias(copies)))
    joined = documents.withColumn(number, F.monotonically_increasing_id()).join(hint_small(mixed, mixed.count(), 1_000_000), F.col(number) == F.col(row), "left")
    same = F.col(row).isNotNull() & F.col(doc_id).eqNullSafe(F.col(i))
    taken = joined.withColumn(copies, F.when(same, F.col(copies)).otherwise(F.raise_error(F.lit("rows came in another order than before: pass a table or a checkpoint")).cast("int")))
    return taken.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)
