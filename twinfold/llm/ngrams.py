"""Interpolated modified Kneser-Ney models over the symbols of whole texts, scored by sharded count joins.

A text is read as its symbols, with one closing symbol behind each word (words stand between ASCII white space); each symbol is predicted
from the order - 1 symbols before it, over word borders too, and a text's start is padded by opening symbols: the order of words counts.

1. Rows are dealt to chunks of consecutive rows, about CHUNK bytes of text each. Tasks count the windows (n-grams of the highest order)
   of a chunk, so n-grams are aggregated before they are shuffled: a row for each chunk and n-gram, with a count over all texts and one
   over target texts.
2. The sums over all chunks are the models' counts. Lower orders hold continuation counts; counts, their contexts' totals and the lower
   order's probabilities meet in joins on the n-gram's context and suffix, sharded by them. All models share these joins: an n-gram
   that a model hasn't counted gets its probability by the same recursion, from its context's weight and the lower order.
3. Probabilities are joined back to the chunks' n-grams and meet the chunk's texts, which are summed up in a stream.

Nothing of a model goes through the driver or is broadcast, whatever its size. Texts are read twice, in steps 1 and 3, and must have the same order
both times: pass a table or a checkpoint. A text whose n-gram has no probability raises.

Two characters are marks here: U+0002 in a text reads as an opening symbol and U+0003 as a closing one. N-grams meet by 64-bit names: of two that
had the same name, counts would be added and one would get the other's probability, without an error. Among 10^9 different n-grams such a
pair is to be expected with a chance of 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, hint_small, mapped, mix64, pinned

OPEN, CLOSE = 2, 3
CHUNK = 32 << 20  # bytes of text in a chunk, about
BLOCK = 1 << 18  # symbols that a task turns into windows at a time
HELD = 1_000_000  # distinct windows that a task counts before it hands them on
SLOTS = 20  # log2 of a task's table of windows
TARGETS = 1_000_000  # ids of target texts are broadcast up to so many (8 bytes each)


# ---- inside a task: windows and tables of them


def runs(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, at, owner, names) of all windows of whole texts, in blocks of about BLOCK symbols; a longer text goes over several.

    Window i is symbols[at[i] : at[i] + order], of text owner[i], and has the 64-bit name names[i].
    """
    pad = chr(OPEN) * (order - 1)
    spread = mix64(np.arange(1, order + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    held, sizes, first = [], [], 0

    def cut(first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        flat = np.frombuffer("".join(held).encode("utf-32-le", "replace"), dtype="<u4")
        n = np.array(sizes, dtype=np.int64)
        begins = np.cumsum(n + order - 1) - (n + order - 1)
        whole = np.ones(len(flat), dtype=bool)  # windows that end in a text, not in the next one's padding
        whole[(begins[:, None] + n[:, None] + np.arange(order - 1)[None, :]).ravel()] = False
        owner = np.repeat(np.arange(first, first + len(n)), n + order - 1)
        for lo in range(0, len(flat) - order + 1, BLOCK):
            part = flat[lo : lo + BLOCK + order - 1]
            m = len(part) - order + 1
            wide = part.astype(np.uint64)
            h = wide[:m] * spread[0]
            for k in range(1, order):
                h += wide[k : k + m] * spread[k]
            at = np.flatnonzero(whole[lo : lo + m])
            yield part, at, owner[lo + at], np.maximum(mix64(h[at]), np.uint64(1))

    held_symbols = 0
    for i, x in enumerate(texts):
        words = x.split()
        text = (b"\3".join(words) + b"\3").decode("utf-8", "replace").replace("\0", "�") if words else ""
        held += [pad, text]
        sizes.append(len(text))
        held_symbols += len(text) + order - 1
        if held_symbols >= BLOCK:
            yield from cut(first)
            held, sizes, first, held_symbols = [], [], i + 1, 0
    if held:
        yield from cut(first)


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts names, where each distinct name begins in it, how often it comes)."""
    order = np.argsort(names)
    new = np.flatnonzero(np.r_[True, np.diff(names[order]) != 0]) if len(names) else np.zeros(0, np.int64)
    return order, new, np.diff(np.r_[new, len(names)])


class Counts:
    """Counts of windows: a table in which a window keeps the slot that it came to first, and a list of those that found theirs taken."""

    def __init__(self, order: int):
        self.order, self.shift = order, np.uint64(64 - SLOTS)
        self.names = np.zeros(1 << SLOTS, np.uint64)  # 0: free
        self.n, self.t = np.zeros((2, 1 << SLOTS), np.int64)
        self.symbols = np.zeros((1 << SLOTS, order), "<u4")
        self.others: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, part: np.ndarray, at: np.ndarray, names: np.ndarray, aimed: np.ndarray) -> None:
        slot = (names >> self.shift).astype(np.int64)
        missing = np.flatnonzero(self.names[slot] != names)
        if len(missing):
            order, new, _ = distinct(names[missing])
            rows = missing[order[new]]
            rows = rows[self.names[slot[rows]] == 0]
            slots, one = np.unique(slot[rows], return_index=True)
            rows = rows[one]
            self.names[slots], self.symbols[slots] = names[rows], part[at[rows][:, None] + np.arange(self.order)]
            self.held += len(rows)
            missing = missing[self.names[slot[missing]] != names[missing]]
            if len(missing):
                order, new, n = distinct(names[missing])
                rows = missing[order[new]]
                self.others.append((names[rows], part[at[rows][:, None] + np.arange(self.order)], n, np.add.reduceat(aimed[missing[order]].astype(np.int64), new)))
                self.held += len(rows)
                free = np.ones(len(slot), dtype=bool)
                free[missing] = False
                slot, aimed = slot[free], aimed[free]
        self.n += np.bincount(slot, minlength=len(self.n))
        if aimed.any():
            self.t += np.bincount(slot[aimed], minlength=len(self.n))
        if len(self.others) > 64:
            self.others = [self.merged()]

    def merged(self) -> tuple[np.ndarray, ...]:
        names, symbols, n, t = (np.concatenate(c) for c in zip(*self.others, strict=True))
        order, new, _ = distinct(names)
        return names[order[new]], symbols[order[new]], np.add.reduceat(n[order], new), np.add.reduceat(t[order], new)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """chunk, name, gram, n, n_target of all windows; a window may have several rows."""
        used = np.flatnonzero(self.names)
        parts = [(self.names[used], self.symbols[used], self.n[used], self.t[used]), *([self.merged()] if self.others else [])]
        for names, symbols, n, t in parts:
            grams = np.ascontiguousarray(symbols).view(f"<U{self.order}").ravel()
            for lo in range(0, len(names), 20_000):
                hi = lo + 20_000
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names[lo:hi]), chunk)), pa.array(names[lo:hi].view(np.int64)), pa.array(grams[lo:hi].tolist(), pa.string()), pa.array(n[lo:hi]), pa.array(t[lo:hi])], ["chunk", "name", "gram", "n", "n_target"])


class Values:
    """Window's name -> a row of values."""

    def __init__(self, names: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - SLOTS)
        self.names, one = np.unique(names, return_index=True)
        self.values = values[one]
        self.at = np.zeros(1 << SLOTS, np.int64)
        self.at[(self.names >> self.shift).astype(np.int64)] = np.arange(len(self.names))

    def of(self, names: np.ndarray) -> np.ndarray:
        """The rows' numbers."""
        if not len(names):
            return np.zeros(0, np.int64)
        if not len(self.names):
            raise ValueError("texts came in another order than before: pass a table or a checkpoint")
        found = self.at[(names >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.names[found] != names)
        if len(left):
            found[left] = np.minimum(np.searchsorted(self.names, names[left]), len(self.names) - 1)
            if (self.names[found[left]] != names[left]).any():
                raise ValueError("texts came in another order than before: pass a table or a checkpoint")
        return found


# ---- on Spark


def chunk_of(documents: DataFrame, text: str) -> Column:
    """A number for each run of consecutive rows of a partition: as many rows, a power of two, as hold CHUNK bytes on average."""
    facts = documents.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size")).first()
    rows = CHUNK * facts["n"] // max(1, facts["size"] or 1)
    return F.shiftright(F.monotonically_increasing_id(), max(0, min(20, rows.bit_length() - 1)))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """chunk, name, gram, n, n_target over rows (chunk, text, target boolean) that come chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chunk = Counts(order), None
        for b in batches:
            of = b.column(0).to_numpy()
            borders = [*np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist(), len(of)]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if chunk != of[lo] or counts.held > HELD:
                    if chunk is not None:
                        yield from counts.rows(chunk)
                    counts, chunk = Counts(order), int(of[lo])
                aimed = np.array(b.column(2).slice(lo, hi - lo).to_pylist(), dtype=bool)
                for part, at, owner, names in runs(as_bytes(b.column(1).slice(lo, hi - lo)), order):
                    counts.add(part, at, names, aimed[owner])
                    if counts.held > 2 * HELD:  # within a long text
                        yield from counts.rows(chunk)
                        counts = Counts(order)
        if chunk is not None:
            yield from counts.rows(chunk)

    return mapped(texts.select("chunk", "text", "target"), run, "chunk long, name long, gram string, n long, n_target long")


def texts_of_chunks(rows: DataFrame) -> DataFrame:
    """chunk, and of up to a batch of its rows: kept and target (arrays), the texts' sizes in bytes and the texts, joined and compressed.

    Compressed together, texts take about 0.6 of the bytes that a shuffle's own compression of single rows leaves of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).to_numpy()
            borders = [*np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist(), len(of)]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                part = b.slice(lo, hi - lo)
                texts = as_bytes(part.column(3))
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                packed = pa.compress(b"".join(texts), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([of[lo]]), one(part.column(1)), one(part.column(2)), one(pa.array(map(len, texts), pa.int32())), pa.array([packed], pa.binary())], ["chunk", "kept", "target", "sizes", "texts"])

    schema = T.StructType([T.StructField("chunk", T.LongType()), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("kept", "target")), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("texts", T.BinaryType())])
    return mapped(rows.select("chunk", "kept", "target", "text"), run, schema)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; 1/2, 1 and 3/2 where the counts of counts are too few for them."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i) for d, i in zip(found, (0.95, 1.9, 2.9), strict=True))


def kneser_ney(counts: DataFrame, order: int, models: Sequence[str], vocabulary: str | None = None) -> DataFrame:
    """counts (gram, and a count for each of `models`) with lp0, lp1 ...: the natural log probability of the gram's last symbol in each model.

    vocabulary: the model whose counted symbols share the last order's uniform part (one more stands for all others); its own, if not given.
    """
    top = counts.select(F.lit(order).alias("k"), "gram", *models)
    levels = top
    if order > 1:
        ends = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("gram", order - k, k + 1).alias("longer")) for k in range(1, order)))
        tails = top.select(F.explode(ends).alias("x"), *((F.col(m) > 0).cast("long").alias(m) for m in models)).groupBy("x.k", "x.longer").agg(*(F.max(m).alias(m) for m in models))
        levels = top.unionByName(tails.groupBy("k", F.expr("substring(longer, 2)").alias("gram")).agg(*(F.sum(m).alias(m) for m in models)))
    levels = pinned(levels)
    facts = levels.groupBy("k").agg(*(F.count_if(F.col(m) > 0).alias(f"{m} all") for m in models), *(F.count_if(F.col(m) == i).alias(f"{m} {i}") for m in models for i in (1, 2, 3, 4))).collect()  # one row an order
    cut = {m: {r["k"]: discounts(*(r[f"{m} {i}"] for i in (1, 2, 3, 4))) for r in facts} for m in models}
    symbols = {m: max([1, *(r[f"{m} all"] for r in facts if r["k"] == 1)]) for m in models}

    def discount(m: str) -> Column:
        d, n = F.lit(0.0), F.col(m)
        for k, (d1, d2, d3) in cut[m].items():
            d = F.when(F.col("k") == k, F.when(n <= 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)).otherwise(d)
        return d

    context = F.expr("substring(gram, 1, k - 1)")
    totals = levels.groupBy("k", context.alias("context")).agg(*(F.sum(m).alias(f"total_{m}") for m in models), *(F.sum(discount(m)).alias(f"cut_{m}") for m in models))
    own = [F.when(F.col(m) > 0, (F.col(m) - discount(m)) / F.col(f"total_{m}")).otherwise(0.0).alias(f"own_{m}") for m in models]
    weight = [F.when(F.col(f"total_{m}") > 0, F.col(f"cut_{m}") / F.col(f"total_{m}")).otherwise(1.0).alias(f"weight_{m}") for m in models]
    shares = pinned(levels.withColumn("context", context).join(totals, ["k", "context"]).select("k", "gram", *own, *weight))
    p = shares.filter("k = 1").select("gram", *((F.col(f"own_{m}") + F.col(f"weight_{m}") / (symbols[vocabulary or m] + 1)).alias(f"p_{m}") for m in models))
    for k in range(2, order + 1):
        below = p.select(F.col("gram").alias("suffix"), *(F.col(f"p_{m}").alias(f"q_{m}") for m in models))
        here = shares.filter(F.col("k") == k).withColumn("suffix", F.expr("substring(gram, 2)")).join(below, "suffix")
        p = here.select("gram", *((F.col(f"own_{m}") + F.col(f"weight_{m}") * F.col(f"q_{m}")).alias(f"p_{m}") for m in models))
    return p.select("gram", *(F.log(f"p_{m}").alias(f"lp{i}") for i, m in enumerate(models)))


def score(documents: DataFrame, targets: DataFrame, order: int, models: Sequence[str], keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """keep columns, target, n_symbols and the log probabilities lp0, lp1 ... of each row's whole text in the models of `models`.

    models: "n" (of all texts) and "n_target" (of the texts of targets.doc_id, distinct ids). Null text has no symbols; a null id is no target.
    """
    ids = pinned(targets.select(F.col("doc_id").alias("id"), F.lit(True).alias("target")))
    n = ids.count()
    rows = documents.select(F.struct(*keep).alias("kept"), F.col(doc_id).alias("id"), F.col(text).alias("text"), chunk_of(documents, text).alias("chunk"))
    flagged = rows.join(hint_small(ids, n, TARGETS), "id", "left").select("chunk", "kept", F.coalesce("target", F.lit(False)).alias("target"), "text")
    # a join of two large sides deals rows anew: then their chunks are put together again
    found = pinned(count_grams(flagged if n <= TARGETS else flagged.repartition("chunk").sortWithinPartitions("chunk"), order))
    sums = pinned(found.groupBy("gram").agg(F.min("name").alias("name"), F.sum("n").alias("n"), F.sum("n_target").alias("n_target")))
    values = kneser_ney(sums.select("gram", *models), order, models, vocabulary).join(sums.select("gram", "name"), "gram").drop("gram")
    lps = [f"lp{i}" for i in range(len(models))]
    asked = found.select("chunk", "name").join(values, "name")
    texts = texts_of_chunks(flagged)
    kinds = {f.name: f.dataType for f in texts.schema}
    # one number orders chunks and, within them, probabilities (even) before texts (odd): Spark sorts it by radix
    place = F.shiftleft("chunk", 1)
    both = asked.select(place.alias("place"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("kept", "target", "sizes", "texts")), "name", *lps)
    every = both.unionByName(texts.select((place + 1).alias("place"), "kept", "target", "sizes", "texts", F.lit(None).cast("long").alias("name"), *(F.lit(None).cast("double").alias(c) for c in lps)))
    dealt = every.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, names, rows, values = None, [], [], None
        for b in batches:
            at = b.column(0).to_numpy()
            of, is_text = at >> 1, at & 1
            borders = [*np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist(), len(at)]
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if chunk != of[lo]:
                    chunk, names, rows, values = of[lo], [], [], None
                if not is_text[lo]:  # probabilities
                    names.append(part.column(5).to_numpy().view(np.uint64))
                    rows.append(np.stack([part.column(6 + i).to_numpy() for i in range(len(lps))], axis=1))
                    continue
                if values is None:
                    values = Values(np.concatenate([np.zeros(0, np.uint64), *names]), np.concatenate([np.zeros((0, len(lps))), *rows]))
                    names, rows = [], []
                for k in range(hi - lo):
                    sizes = part.column(3)[k].values.to_numpy()
                    many = len(sizes)
                    ends = np.cumsum(sizes).tolist()
                    raw = pa.decompress(part.column(4)[k].as_buffer(), ends[-1], "zstd", asbytes=True) if ends[-1] else b""
                    n, sums = np.zeros(many, np.int64), np.zeros((len(lps), many))
                    for _, _, owner, known in runs([raw[a:z] for a, z in zip([0, *ends], ends, strict=False)], order):
                        n += np.bincount(owner, minlength=many)
                        rank = values.of(known)
                        for i in range(len(lps)):
                            sums[i] += np.bincount(owner, weights=values.values[rank, i], minlength=many)
                    yield pa.RecordBatch.from_arrays([part.column(1)[k].values, part.column(2)[k].values, pa.array(n), *map(pa.array, sums)], ["kept", "target", "n_symbols", *lps])

    schema = flagged.select("kept", "target").schema.add("n_symbols", "long")
    for c in lps:
        schema = schema.add(c, "double")
    out = mapped(dealt.select("place", "kept", "target", "sizes", "texts", "name", *lps), run, schema)
    taken = [f"kept.{c}" for c in keep]
    return out.select(*taken, "target", "n_symbols", *lps)
