"""Near-duplicate detection by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Texts of equal sets form a class, found by a digest of the set
   with map-side aggregation, so thousands of copies travel as one row.
2. Band candidates: each class hashes bands of ROWS minima, as many as leave a link of the threshold's similarity without a common band
   with probability MISSED at most (20 bands at 0.85, 29 at 0.8). Classes that share a band's hash (a bucket) are candidates of each
   other. Buckets of the same members are one.
3. b-bit signatures: classes with candidates keep the low BITS bits of K minima, packed into longs. Bit counts of two signatures give
   the collision-corrected similarity (matches - c) / (1 - c) with c = 2**-BITS; candidates more than MARGIN standard errors below the
   threshold go, which loses a link with probability under 1e-4, and so does a set size that rules the threshold out.
4. Links are confirmed on the full sets, in the task that compares a block of a bucket; pairs never leave the task, which hands on only
   what they join: each component that is no longer the smallest of its group, with the smallest. Buckets of up to BLOCK members are one
   block and done with that.
5. A larger bucket is dealt to blocks, each member to one. After the components of the links found, only buckets with several components
   are taken up again: first one representative of each, then, with no cap, every member outside the bucket's largest component
   against every other member, in pairs of blocks of WIDE. Members of one component aren't compared again; that changes no component.

Nulls: null or empty text has no shingles and is linked with nothing. Rows are told apart by number, so a repeated id may have several
texts, and repeated rows are copies of each other. A null id can't name a component: a component takes the smallest id of its rows, or null if all are null. Very long texts are
hashed in parts of PART bytes; blocks are also bounded by their shingles. Only the named columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, chunks, fresh, hint_small, mapped, mix64, pinned

ROWS, K, BITS, MARGIN, MISSED = 5, 1024, 2, 4.0, 1e-5
BLOCK, WIDE = 256, 1024  # members of a block
COMMON = 200  # copies of a set that rows join by broadcast: there is at most one such class in so many rows
MOST_SHINGLES = 4_000_000  # of a block, about
PAIRS = 32_000  # compared at once
PART = 1 << 18
BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SPACES = re.compile(rb"[\t-\r ]")


def bands_for(threshold: float) -> int:
    """Bands of ROWS minima that a link of this similarity shares none of with probability MISSED at most."""
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - min(threshold, 0.999) ** ROWS) - 1e-9))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i in any part with its last word."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(2 * PART + 4, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places where words begin, hashes of the words) of at most 2 * PART bytes that begin and end with white space."""
    flat = np.frombuffer(text, dtype=np.uint8)
    space = _SPACE[flat]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers()
    ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.astype(np.uint64) * up[: len(flat)])])
    return start, mix64((ahead[end] - ahead[start]) * down[start] + (end - start).astype(np.uint64))


def _long_word(word: bytes) -> np.ndarray:
    """The hash of one word, as of _words, in parts."""
    total = np.uint64(0)
    for at in range(0, len(word), PART):
        flat = np.frombuffer(word[at : at + PART], dtype=np.uint8).astype(np.uint64)
        total = total + (flat * _powers()[0][: len(flat)]).sum(dtype=np.uint64) * np.uint64(pow(BASE, at, 1 << 64))
    return mix64(np.array([total + np.uint64(len(word))], dtype=np.uint64))


def _long_text(text: bytes) -> np.ndarray:
    """Word hashes of a text of any length, in parts cut at white space."""
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        gap = _SPACES.search(text, min(at + PART, len(text)))
        end = gap.start() if gap else len(text)
        if end - at <= 2 * PART - 2:
            found.append(_words(b"\n" + text[at:end] + b"\n")[1])
        else:  # a word reaches over the part's end
            last = max(text.rfind(s, at, at + PART) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            found += [_words(b"\n" + text[at : max(at, last)] + b"\n")[1], _long_word(text[max(at, last + 1) : end])]
        at = end + 1
    return np.concatenate(found)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words (A-Z lowered); one for the whole text if it has fewer words."""
    sets: list[np.ndarray] = []
    for lo, hi in chunks(texts, PART):
        some = [x.lower() for x in texts[lo:hi]]
        if len(some) == 1 and len(some[0]) > PART:
            word = _long_text(some[0])
            first = np.array([0, len(word)])
        else:
            start, word = _words(b"\n" + b"\n".join(some) + b"\n")
            first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])]) + 1)
        for a, b in zip(first[:-1], first[1:], strict=True):
            w = word[a:b]
            n = len(w)
            if not n:
                sets.append(w)
                continue
            m = max(1, n - width + 1)
            h = np.full(m, min(n, width), dtype=np.uint64)
            for k in range(min(n, width)):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + m])
            sets.append(np.unique(h))
    return sets


@lru_cache(4)
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, K, dtype=np.uint64)[:k, None] * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, K, dtype=np.uint64)[:k, None]


def minima(shingles: np.ndarray, k: int) -> np.ndarray:
    """k minima of a set under k hash functions, 32 bits each."""
    a, b = _permutations(k)
    best = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, 200_000 // k)
    for lo in range(0, len(shingles), step):
        best = np.minimum(best, (a * shingles[None, lo : lo + step] + b).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint64)


def band_hashes(low: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of ROWS minima, its number included; never 0."""
    m, h = low[: bands * ROWS].reshape(bands, ROWS), np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
    return np.maximum(h, np.uint64(1)).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Low BITS bits of minima, 64 // BITS to a long."""
    per = 64 // BITS
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarities of packed signatures, row by row, by bit counts."""
    mask = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    x = a.view(np.uint64) ^ b.view(np.uint64)
    differ = x.copy()
    for s in range(1, BITS):
        differ |= x >> np.uint64(s)
    c = 2.0**-BITS
    return ((1 - np.bitwise_count(differ & mask).sum(axis=1, dtype=np.int64) / K) - c) / (1 - c)


def least_estimate(threshold: float) -> float:
    c = 2.0**-BITS
    p = c + (1 - c) * threshold
    return threshold - MARGIN * (p * (1 - p) / K) ** 0.5 / (1 - c)


def sketch(rows: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, t, n_shingles, d1 and d2 (the set's digest; null without shingles) and bands (hashes) of rows (doc_id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n, d1, d2, found = [], [], [], []
                for s in shingle_sets(as_bytes(part.column(2)), width):
                    n.append(len(s))
                    if not len(s):
                        d1.append(None), d2.append(None), found.append([])
                        continue
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    d1.append(int(digest[0])), d2.append(int(digest[1]))
                    found.append(band_hashes(minima(s, bands * ROWS), bands))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "t", "n_shingles", "d1", "d2", "bands"])

    return mapped(rows.select("doc_id", "t", "text"), run, "doc_id long, t binary, n_shingles long, d1 long, d2 long, bands array<long>")


def signed(rows: DataFrame, width: int) -> DataFrame:
    """rows with `signature`, the packed bits of their column text."""
    names = [*rows.columns, "signature"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [packed(minima(s, K)) for s in shingle_sets(as_bytes(part.column(at)), width)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], names)

    return mapped(rows, run, rows.select("*").schema.add("signature", T.ArrayType(T.LongType())))


# ---- inside a task: the links of whole blocks


class Block:
    """Members of one or more whole blocks, sorted by block and side, and which of them are joined."""

    def __init__(self, table: pa.Table, width: int, percent: int):
        self.width, self.percent, self.threshold = width, percent, percent / 100
        self.node, self.label, self.n, self.side = (table[c].to_numpy() for c in ("node", "label", "n", "side"))
        self.signature, self.bands = (table[c].combine_chunks().flatten().to_numpy().reshape(len(table), -1) for c in ("signature", "bands"))
        self.bucket, self.text = table["bucket"].to_numpy(), table["text"]
        self.key = table["key"].to_numpy()
        self.labels, self.first, self.root = np.unique(self.label, return_index=True, return_inverse=True)
        self.sets: dict[int, np.ndarray] = {}

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of all pairs to compare, about PAIRS at a time: side 0 by side 1, or all pairs of a block without sides (-1)."""
        rows = np.arange(len(self.key))
        new = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        end = np.repeat(np.r_[new[1:], len(rows)], np.diff(np.r_[new, len(rows)]))
        second = np.where(self.side == 1, rows, len(rows))  # the first row of side 1 at or after a row
        second = np.minimum.accumulate(second[::-1])[::-1]
        begin = np.where(self.side < 0, rows + 1, np.where(self.side == 0, np.minimum(second, end), end))
        count = end - begin
        total = np.cumsum(count)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            k = count[at:to]
            if k.sum():
                x = np.repeat(rows[at:to], k)
                yield x, np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[at:to], k)
            at = to

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs not joined yet whose estimated similarity may reach the threshold, each in the first bucket that the two share."""
        least = least_estimate(self.threshold)
        for x, y in self.pairs():
            small, large = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
            ok = (self.root[x] != self.root[y]) & (small >= self.threshold * large - 1e-9)
            x, y = x[ok], y[ok]
            ok = estimates(self.signature[x], self.signature[y]) >= least
            x, y = x[ok], y[ok]
            same = (self.bands[x] == self.bands[y]) & (self.bands[x] != 0)
            ok = self.bands[x, same.argmax(axis=1)] == self.bucket[x]
            if ok.any():
                yield x[ok], y[ok]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Labels that links, confirmed on the full sets, join with a smaller one, and the smallest that each is joined with."""
        for x, y in self.candidates():
            asked = np.setdiff1d(np.unique(np.concatenate([x, y])), list(self.sets))
            for lo in range(0, len(asked), 500):
                some = asked[lo : lo + 500]
                self.sets |= zip(some.tolist(), shingle_sets(as_bytes(self.text.take(pa.array(some)).combine_chunks()), self.width), strict=True)
            common = self.common(x, y)
            ok = (100 * common >= self.percent * (self.n[x] + self.n[y] - common)) & (common > 0)
            for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if self.root[i] != self.root[j]:
                    self.root[self.root == self.root[j]] = self.root[i]
        group = self.root[self.first]
        least = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(least, group, self.labels)
        moved = least[group] != self.labels
        return self.labels[moved], least[group][moved]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs' sets (x sorted)."""
        if len(x) < 64:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
        rows = np.unique(np.concatenate([x, y]))
        each = [self.sets[i] for i in rows.tolist()]
        number = np.unique(np.concatenate(each), return_inverse=True)[1]  # shingles as small numbers
        ends = np.cumsum([0, *map(len, each)])
        at = {r: number[ends[k] : ends[k + 1]] for k, r in enumerate(rows.tolist())}
        mine, out = np.zeros(int(number.max()) + 1, dtype=bool), np.empty(len(x), dtype=np.int64)
        new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(x)], strict=True):
            own = at[int(x[lo])]
            mine[own] = True
            theirs = [at[j] for j in y[lo:hi].tolist()]
            out[lo:hi] = np.add.reduceat(mine[np.concatenate(theirs)].astype(np.int64), np.cumsum([0, *map(len, theirs[:-1])]))
            mine[own] = False
        return out


def linked(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): labels joined by links of members (key, side, bucket, node, label, n, bands, signature, text) of whole blocks, a block's key being dealt to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
            if held is None or not len(held):
                continue
            key = held["key"].to_numpy()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = new[1:] if batch is not None else np.r_[new[1:], len(held)]  # the last block may go on
            shingles, begin, size = np.cumsum(held["n"].to_numpy()), 0, len(held)
            for k, end in enumerate(ends.tolist()):  # blocks of about 2,000 members together
                last = k + 1 == len(ends)
                if last or ends[k + 1] - begin > 2000 or shingles[ends[k + 1] - 1] - shingles[begin] > MOST_SHINGLES:
                    a, b = Block(held.slice(begin, end - begin), width, percent).links()
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    begin = end
            held = held.slice(begin) if begin < size else None

    rows = dealt.select("key", "side", "bucket", "node", "label", "n", "bands", "signature", "text")
    return mapped(rows.repartition("key").sortWithinPartitions("key", "side"), run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


# ---- components


def components(links: DataFrame, n: int) -> DataFrame:
    """(id, label): the smallest id that each linked id reaches, without the ids that reach no smaller one. n: rows of links, or more.

    Each id's smaller neighbours are linked to the least of them, or to that one's own least neighbour, instead of to the id, and the id
    too. No path is lost and no link is added, until every id has one neighbour, which has none. An id that many others are linked to
    has no row for each: these are told apart by the larger end.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        near = pinned(edges.groupBy("u").agg(F.collect_set("v").alias("all")).select("u", F.array_min("all").alias("v"), "all"))
        up = near.select(F.col("u").alias("v"), F.col("v").alias("top"))
        moved = near.join(hint_small(up, n), "v", "left")
        if near.filter(F.size("all") > 1).isEmpty() and moved.filter("top is not null").isEmpty():
            return near.select(F.col("u").alias("id"), F.col("v").alias("label"))
        from_ = F.explode(F.concat(F.array("u"), F.array_remove("all", F.col("v"))))
        edges = moved.select(from_.alias("u"), F.coalesce("top", "v").alias("v"))


def merged(labels: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """labels (id, label) after more links; n: rows of both, or more."""
    return components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(links), n)


def blocks_of(members: Column, shingles: Column, most: int) -> Column:
    """Blocks for so many members with so many shingles together."""
    return F.greatest(F.lit(1), F.ceil(members / most), F.ceil(shingles / MOST_SHINGLES)).cast("int")


def candidate_nodes(classes: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """node, n, bands (0 where nobody shares it), at (bucket, blocks of each shared one), text and signature of classes with candidates."""
    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    digest = [F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")]
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), *digest).filter("size > 1")
    # buckets of the same members (near copies share most bands) give the same candidates: one of them is kept
    kept = pinned(sizes.groupBy("size", "shingles", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", blocks_of(F.col("size"), F.col("shingles"), BLOCK).alias("blocks")))
    shared = banded.join(hint_small(kept, kept.count()), "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("at"))  # at most a row a band
    known = F.transform("at", lambda x: x["bucket"])
    own = F.transform("bands", lambda b: F.when(F.array_contains(known, b), b).otherwise(F.lit(0)))
    asked = pinned(classes.join(shared, "node").select("node", F.col("t").alias("t_"), F.col("best.doc_id").alias("id_"), "n", own.alias("bands"), "at"))
    n = asked.count()
    texts = source.join(hint_small(asked.select("node", "t_", "id_"), n), (F.col("t") == F.col("t_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
    found = pinned(signed(texts.select("node", "text").join(asked.select("node", "n", "bands", "at"), "node"), width))
    return found if found.count() == n else pinned(found.dropDuplicates(["node"]))  # rows may be repeated


def class_labels(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, label) of the linked ones among candidate nodes."""
    own = nodes.select("node", F.col("node").alias("label"), "n", "bands", "signature", "text", F.explode("at").alias("x"))
    mine = F.pmod(F.xxhash64("node"), F.col("x.blocks"))
    first = own.select(F.xxhash64("x.bucket", mine).alias("key"), F.lit(-1).alias("side"), "x.bucket", "node", "label", "n", "bands", "signature", "text")
    links = pinned(linked(first, width, percent))
    n = links.count()
    labels = components(links, n)
    hot = pinned(nodes.select("node", "n", F.explode("at").alias("x")).filter("x.blocks > 1").select("node", "n", "x.bucket"))
    if hot.isEmpty():
        return with_least(labels)
    texts = nodes.select("node", "bands", "signature", "text")

    def spread(labels: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
        """Members of hot buckets with their labels, the buckets that hold several, and how many such buckets and labels in them there are."""
        members = hot.join(hint_small(labels.select(F.col("id").alias("node"), "label"), n), "node", "left").withColumn("label", F.coalesce("label", "node"))
        groups = members.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        most = F.max(F.struct("size", "shingles", "label"))
        mixed = pinned(groups.groupBy("bucket").agg(F.count("*").alias("n_labels"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), most.alias("most")).filter("n_labels > 1"))
        return members, mixed, *mixed.agg(F.count("*"), F.coalesce(F.sum("n_labels"), F.lit(0))).first()

    for turn in range(2):  # representatives: one member of each component in a bucket
        members, mixed, buckets, n_labels = spread(labels)
        if not buckets:
            return with_least(labels)
        sized = mixed.select("bucket", blocks_of(F.col("n_labels"), F.col("shingles") * F.col("n_labels") / F.col("size"), BLOCK).alias("blocks"))
        some = members.join(hint_small(sized, buckets), "bucket")
        chosen = some.groupBy("bucket", "label", "blocks").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n")).alias("x")).select("bucket", "label", "blocks", "x.node", "x.n")
        dealt = chosen.withColumn("key", F.xxhash64("bucket", F.pmod(F.xxhash64("label", F.lit(turn)), F.col("blocks")))).withColumn("side", F.lit(-1)).drop("blocks")
        links = pinned(linked(texts.join(hint_small(dealt, n_labels), "node"), width, percent))
        found = links.count()
        if not found:
            break
        n += found
        labels = merged(labels, links, n)
    members, mixed, buckets, _ = spread(labels)
    if not buckets:
        return with_least(labels)
    others = blocks_of(F.col("size") - F.col("most.size"), F.col("shingles") - F.col("most.shingles"), WIDE)
    sized = mixed.select("bucket", F.col("most.label").alias("largest"), others.alias("others"), blocks_of(F.col("most.size"), F.col("most.shingles"), WIDE).alias("rest"))
    placed = members.join(hint_small(sized, buckets), "bucket").withColumn("outside", F.col("label") != F.col("largest"))
    number = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64("node"), F.col("rest")))
    partners = F.sequence(F.lit(0), F.when(F.col("outside"), F.col("others") + F.col("rest")).otherwise(F.col("others")) - 1)
    pairs = placed.withColumn("mine", number.cast("int")).withColumn("other", F.explode(partners))
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = pairs.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), side.alias("side"), "bucket", "node", "label", "n")
    links = pinned(linked(dealt.join(texts, "node"), width, percent))
    found = links.count()
    return with_least(merged(labels, links, n + found) if found else labels)


def with_least(labels: DataFrame) -> DataFrame:
    """labels (id, label) and those ids that are labels themselves."""
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())


def groups(documents: DataFrame, width: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, t (the text's md5), n_shingles, component_id and first (true for one row of each component) of each row."""
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("t"), F.col(text).alias("text"))
    rows = pinned(sketch(source, width, bands_for(percent / 100)).withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t", "row")).alias("best")
    found = rows.filter("d1 is not null").groupBy("d1", "d2").agg(best, F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = pinned(found.select("d1", "d2", "best", "copies", F.col("best.t").alias("t"), "n", "bands").withColumn("node", F.monotonically_increasing_id()))
    labels = class_labels(candidate_nodes(classes, source, width), width, percent)
    linked_ = classes.select("node", "d1", "d2", "best").join(labels.withColumnRenamed("id", "node"), "node")
    heads = linked_.groupBy("label").agg(F.min("best").alias("head"))
    named = linked_.join(heads, "label").select("d1", "d2", "head")
    every = pinned(classes.select("d1", "d2", "best", "copies").join(named, ["d1", "d2"], "left").select("d1", "d2", "copies", F.coalesce("head", "best").alias("head")))
    # rows without a shingle need no class, and classes of many copies are few: neither meet in one task
    common = every.filter(F.col("copies") > COMMON).drop("copies")
    common = hint_small(common, common.count())
    own = rows.select("doc_id", "t", "n_shingles", "row", "d1", "d2")
    alone = own.filter("d1 is null").withColumn("head", F.lit(None).cast(every.schema["head"].dataType))
    some = own.filter("d1 is not null")
    rest = some.join(common.select("d1", "d2"), ["d1", "d2"], "left_anti").join(every.filter(F.col("copies") <= COMMON).drop("copies"), ["d1", "d2"])
    joined = rest.unionByName(some.join(common, ["d1", "d2"])).unionByName(alone)
    void = F.col("d1").isNull()
    return joined.select("doc_id", "t", "n_shingles", F.when(void, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), (void | (F.col("row") == F.col("head.row"))).alias("first"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the linked group) and kept of each row; links are of percent / 100 similarity or more.

    kept: the row's id names its component; a row without id is kept if it is the one that `deduplicated` keeps.
    """
    found = groups(documents, width, percent, text, doc_id)
    return found.select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNull(), F.col("first")).otherwise(F.col("doc_id") == F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """documents with one row of each component: that of the smallest id (rows without id last). All rows without a shingle stay."""
    found = groups(documents, width, percent, text, doc_id).filter("n_shingles > 0").groupBy("doc_id", "t").agg(F.bool_or("first").alias("stays"), F.count("*").alias("n"))
    key, i, t = fresh(documents.columns, "text_md5", "gone_id", "gone_md5")
    told = pinned(found.filter("not stays or n > 1").select(F.col("doc_id").alias(i), F.col("t").alias(t), "stays"))  # nothing to do about the others
    keyed = documents.withColumn(key, F.unhex(F.md5(F.col(text))))
    gone, again = (told.filter(w).drop("stays") for w in ("not stays", "stays"))
    n = {r["stays"]: r["count"] for r in told.groupBy("stays").count().collect()}  # two rows at most

    def rows_of(left: DataFrame, marks: DataFrame, how: str, n: int) -> DataFrame:
        return left.join(hint_small(marks, n), F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(t)), how)

    left = rows_of(keyed, gone, "left_anti", n[False]) if n.get(False) else keyed
    if n.get(True):  # repeated rows: equal id and text
        left = rows_of(left, again, "left_anti", n[True]).unionByName(rows_of(left, again, "left_semi", n[True]).dropDuplicates([doc_id, key]))
    return left.select(*documents.columns)
