"""Source divergence audit: how far each source's word shares are from the other sources' and from its language's, by run-length columns.

Words are counted once per document in the tasks, combined there, and summed by (lang, source, term); a term is kept that enough documents
of its language have. The kept terms of a language are dealt into blocks of about BLOCK terms; inside a block the vocabulary is reordered by
the terms' counts, so that equal counts stand together, and each source's counts become a run-length column: one row of ends of runs
and their counts. Two columns of one block are compared by intersecting the boundaries of their runs: f at each common run times its length.
Sources are dealt into chunks of SOURCES, and a pair of chunks meets once a block, so neither many sources nor a large vocabulary comes
together in one task. Sums over blocks are taken by Spark.

The share p of a count c is 1 + floor(10^9 (c + 5) / (N + 5 V)), by long division in three steps of 10^3: exact while N + 5 V is below 9 10^15.
Nulls in text, lang and source are empty texts. Texts without terms, repeated rows and ids, and very long texts are ordinary; only the named columns are
read, whatever the others are called. Empty tables give an empty result. A group without terms has the smoothed share alone; a language
without kept terms has differences of 0 and no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, chunks, hint_small, mapped, pinned

DOCUMENTS = 30  # of a language that must have a term
TOP = 50
SCALE, SMOOTH = 1_000_000_000, 5
BLOCK = 1024  # terms compared together, about
SOURCES = 128  # sources compared together with as many others
HELD = 1_000_000  # counted rows of a task that wait to be combined

#: Term letters: ASCII letters in lower case and all bytes of other characters; every other byte is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def term_counts(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): one row each, summed over the table and dealt by (lang, term)."""
    keys = ["lang", "source", "term"]

    def combined(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*keys, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            texts = [x.translate(_LETTERS) for x in as_bytes(b.column(2))]
            group = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"])
            for lo, hi in chunks(texts):
                words = pc.split_pattern(pa.array(texts[lo:hi], pa.large_binary()), " ")
                each = words.flatten().dictionary_encode()
                word, many = each.indices.to_numpy().astype(np.int64), len(each.dictionary)
                row = np.repeat(np.arange(hi - lo), np.diff(words.offsets.to_numpy()))
                pair, n = np.unique(row * many + word, return_counts=True)  # (document, word)
                found = pa.table({"at": pair // many + lo, "word": pair % many, "n": n})
                found = found.filter(pc.not_equal(pc.binary_length(each.dictionary.take(found["word"])), 0))
                flat = pa.table({"lang": group.field(0).take(found["at"]), "source": group.field(1).take(found["at"]), "term": each.dictionary.take(found["word"]).cast(pa.binary()), "n": found["n"], "docs": pa.array(np.ones(len(found), np.int64))})
                held.append(combined([flat]))
                rows += len(held[-1])
            if rows > HELD:
                held = [combined(held)]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held, rows = [], 0
        if held:
            yield from combined(held).to_batches(max_chunksize=20_000)

    named = documents.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    counted = mapped(named, run, "lang string, source string, term binary, n long, docs long")
    # tasks have combined their rows: of a term there are as many as tasks and sources, so its sources can be dealt together
    dealt = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return dealt.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) by long division, for count <= total."""
    step = lambda rest: (rest * 1000, total)
    found, rest = F.lit(1).cast("long"), count
    for k in (1_000_000, 1_000, 1):
        up, by = step(rest)
        found, rest = found + F.call_function("div", up, by) * k, up % by
    return found


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """As `share`, of an array."""
    found, rest = np.ones(len(count), np.int64), count.astype(np.int64)
    for k in (1_000_000, 1_000, 1):
        rest = rest * 1000
        found += rest // total * k
        rest %= total
    return found


def run_length(places: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of the runs of equal counts in a column of `width` places; those not named are 0."""
    column = np.zeros(width, np.int64)
    column[places] = counts
    first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]][:width])
    return first, column[first]


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> int:
    """Sum of |a - b| over two run-length columns: their boundaries intersected, each difference times its run's length."""
    first = np.union1d(a[0], b[0])
    at = lambda c: c[1][np.searchsorted(c[0], first, side="right") - 1]
    return int((np.abs(at(a) - at(b)) * np.diff(first, append=width)).sum())


def pair_sums(groups: DataFrame, kept: DataFrame, blocks: DataFrame) -> DataFrame:
    """lang, a, b, value: the differences of all ordered pairs of sources, summed over the language's kept terms.

    groups: lang, source, chunk, chunks, total (N + 5 V), n_blocks. kept: lang, source, term, block, n. blocks: lang, term, block, order of
    the terms inside it.
    """
    order = Window.partitionBy("lang", "block").orderBy("total", "pattern", "term")
    placed = blocks.withColumn("place", F.row_number().over(order) - 1).select("lang", "term", "block", "place")
    # a column has at most a block's terms
    columns = kept.join(placed.drop("block"), ["lang", "term"]).groupBy("lang", "source", "block").agg(F.collect_list(F.struct("place", "n")).alias("cells"))
    widths = placed.groupBy("lang", "block").agg(F.count("*").alias("width"))
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")).join(widths, ["lang", "block"], "left")
    full = every.join(columns, ["lang", "source", "block"], "left")
    # the pair of chunks (x, y), x <= y, has the columns of both
    met = full.select("lang", "block", "source", "chunk", "total", F.coalesce("width", F.lit(0)).alias("width"), F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other")).drop("other")

    def compare(t: pa.Table) -> pa.Table:
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        width = t["width"][0].as_py()
        entries = []
        for source, chunk, total, places, counts in zip(*(t[c].to_pylist() for c in ("source", "chunk", "total", "places", "counts")), strict=True):
            first, count = run_length(np.array(places or [], np.int64), np.array(counts or [], np.int64), width)
            entries.append((source, chunk, (first, shares(count + SMOOTH, total) if width else count)))
        left = [e for e in entries if e[1] == x]
        right = left if x == y else [e for e in entries if e[1] == y]
        a, b, value = [], [], []
        for i, p in enumerate(left):
            for q in right[i + 1 :] if x == y else right:
                v = difference(p[2], q[2], width) if width else 0
                a += [p[0], q[0]]
                b += [q[0], p[0]]
                value += [v, v]
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    parts = met.groupBy("lang", "block", "x", "y").applyInArrow(compare, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank; see the module's text."""
    counts = term_counts(documents, text, lang, source)
    of_term = Window.partitionBy("lang", "term")  # its rows are one per source
    pattern = F.shiftright(F.xxhash64("source", "n"), 24)
    counts = counts.select("lang", "source", "term", "n", *(F.sum(c).over(of_term).alias(n) for n, c in (("docs", F.col("docs")), ("n_all", F.col("n")), ("pattern", pattern))))
    counts = pinned(counts.filter(F.col("docs") >= least).drop("docs"))
    terms = counts.groupBy("lang", "term").agg(F.max("n_all").alias("total"), F.max("pattern").alias("pattern"))
    per_lang = pinned(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang")))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("lang", "term"), F.col("n_blocks")).cast("int").alias("block")
    langs = per_lang.count()
    sized = hint_small(per_lang.withColumn("n_blocks", n_blocks), langs)  # a language with most of the rows must not be one task
    dealt = terms.join(sized, "lang").select("lang", "term", block, "total", "pattern")
    kept = counts.join(sized, "lang").select("lang", "source", "term", "n", "n_all", "v", "n_lang", block)

    shown = documents.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = shown.join(sizes, ["lang", "source"], "left").join(hint_small(per_lang, langs), "lang", "left")
    groups = groups.select("lang", "source", (F.coalesce("n_group", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("total"), n_blocks.alias("n_blocks"), F.coalesce("v", F.lit(0)).alias("v"))
    per = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("chunks"))
    groups = pinned(groups.join(hint_small(per, langs), "lang").withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")))

    pairs = pair_sums(groups, kept.select("lang", "source", "term", "block", "n"), dealt)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))
    own = kept.join(hint_small(groups.select("lang", "source", F.col("total").alias("of")), groups.count()), ["lang", "source"])
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share(F.col("n") + SMOOTH, F.col("of")) - share(F.col("n_all") + SMOOTH, F.col("n_lang") + SMOOTH * F.col("v"))).alias("value"))
    terms_ = own.filter("value > 0").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms_)
