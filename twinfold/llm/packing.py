"""Best-fit packing of documents into sequences of fixed capacity.

Bulk-synchronous best-fit: documents (pieces) are range-sorted by length, largest first, gaps by size. A superstep takes the run of all
documents of one length and sweeps the gaps for successors: each document goes to the smallest gap that holds it; which document of
the run gets which gap is settled by its rank within the run. Then gaps are updated and the next length follows. Lengths are integers up
to the capacity, so both sorted orders are run-length coded: the sweep sees at most `capacity` runs of documents, however many documents
there are. The sweep over these runs is done on the driver (a superstep of its own in Spark for each of 2,048 lengths would take longer
than all other work); Spark counts the runs, ranks the documents (salted by rows, so that a length that a third of all rows share is split)
and places them. Only the counts by length come to the driver.

The result is the one of sequential best-fit-decreasing. Nulls: null text is empty, and a document always has its closing id. Null or
repeated ids are ordinary rows (placed once per row). Very long texts are cut into pieces. Only the named columns are read, whatever the
others are called. Empty tables give an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import sums_before
from .common import as_bytes, chunks, fresh, mapped, pinned

CAPACITY = 2048
PER_SALT = 20_000  # rows that are ranked together, about


def plan_supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, documents a gap takes, first sequence, offset) for so many documents of each length.

    The documents of a length from `first rank` on, up to the next run of that length, fill consecutive sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap size -> runs of sequences (first, number)
    sizes: list[int] = []
    runs, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
            else:
                gap, first, n = capacity, opened, max(1, left // (capacity // length))
                opened += n
            each = gap // length
            whole = min(n, left // each)
            if whole == 0:  # fewer documents than one gap takes
                put(gap, first + 1, n - 1)
                n, whole, each = 1, 1, left
            put(gap, first + whole, n - whole)
            runs.append((length, rank, each, first, capacity - gap))
            put(gap - each * length, first, whole)
            rank += whole * each
            left -= whole * each
    return runs


def best_fit(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id (0 and up) and offset (gapless within a sequence). Lengths must be 1 to capacity; rows of one length are alike.

    items is read twice: pass a pinned table.
    """
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most `capacity` rows
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    runs = plan_supersteps(counts, capacity)
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    shared = items.sparkSession.sparkContext.broadcast(table[order])  # bounded by the capacity, not by the documents
    stride = np.int64(1 << 44)

    salt, start, rank_, number = fresh(items.columns, "salt", "start", "rank", "number")
    parts = max(1, sum(counts.values()) // PER_SALT)  # a length may have most of the rows: it is split like all of them
    salted = items.withColumn(number, F.monotonically_increasing_id()).withColumn(salt, F.pmod(F.xxhash64(number), F.lit(parts)).cast("int"))
    sizes = salted.groupBy(length, salt).agg(F.count("*").alias(start))
    starts = sums_before(sizes, [length], F.floor(F.col(salt) / 256), [F.col(salt)], {rank_: F.col(start)}).select(F.col(length), F.col(salt), F.col(rank_).alias(start))
    within = Window.partitionBy(length, salt).orderBy(number)
    ranked = salted.join(starts, [length, salt]).withColumn(rank_, F.col(start) + F.row_number().over(within) - 1).select(*items.columns, rank_)
    schema = items.select("*").schema.add("sequence_id", "long").add("offset", "long")
    at = items.columns.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = runs[:, 0] * stride + runs[:, 1]
        for b in batches:
            size = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            run = runs[np.searchsorted(starts, size * stride + rank, side="right") - 1] if len(size) else runs[:0]
            ahead = rank - run[:, 1]
            each = np.maximum(run[:, 2], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(run[:, 3] + ahead // each), pa.array(run[:, 4] + ahead % each * size)], schema.names)

    return mapped(ranked, place, schema)


#: Classes of bytes in plain words: 1 for letters (A-Z, a-z and the two bytes of Latin-1's letters, not its two signs), 2 for marks, 0 for all else.
#: Not marks: the apostrophe, which may begin a pre-token of letters, and <, which may begin a special token.
_CLASS = np.array([1 if chr(b).isascii() and chr(b).isalpha() or b == 0xC3 or 0x80 <= b <= 0xBF and b not in (0x97, 0xB7) else 2 if chr(b) in "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~" else 0 for b in range(256)], dtype=np.uint8)
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def byte_letters() -> np.ndarray:
    """The letter's code point that stands for each byte in byte-level vocabularies: itself where printable, else one from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = np.arange(256, dtype="<u4")
    hidden = [b for b in range(256) if b not in shown]
    out[hidden] = 256 + np.arange(len(hidden))
    out[32] = 32  # the space parts pre-tokens
    return out


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    ends = np.cumsum(size)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def as_list(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    raw = column.buffers()[2].to_pybytes() if column.buffers()[2] else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def tokenizer_words(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """words -> (ids of all words, number of ids of each), for a tokenizer that never merges over ASCII white space.

    A lower-casing byte-level vocabulary with word ends is asked for many plain words in one text: each of their pre-tokens (a run of
    letters, or of marks) closes with the one id whose entry has the end mark, so the ids can be cut into words again. Other words, or
    other kinds of vocabulary, are encoded one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: a pool of threads in each worker only costs memory and CPU
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)  # one for both ways: its pages are most of a worker's memory
    mark = getattr(tokenizer.model, "end_of_word_suffix", None)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found))

    if not mark:
        return encode
    full, bare = (tokenizer.normalizer, tokenizer.pre_tokenizer), (normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit())
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    closes[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
    del vocabulary
    letters = byte_letters()

    def of_plain(flat: np.ndarray, pretokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of plain words with a space after each; pretokens: how many each of them has."""
        kind = _CLASS[flat]
        upper = (flat >= 65) & (flat <= 90)
        upper[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)
        flat = flat + upper * np.uint8(32)
        flat = np.insert(flat, np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1, 32)
        cuts = np.flatnonzero(flat == 32)[999::1000] + 1
        texts = [x.tobytes().decode("utf-32-le") for x in np.split(letters[flat], cuts)]
        tokenizer.normalizer, tokenizer.pre_tokenizer = bare
        try:
            ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        finally:
            tokenizer.normalizer, tokenizer.pre_tokenizer = full
        ends = np.r_[0, np.flatnonzero(closes[ids]) + 1]
        if len(ends) != pretokens.sum() + 1:
            raise ValueError("the vocabulary's word ends don't follow its pre-tokens")
        return ids, np.diff(ends[np.cumsum(pretokens)], prepend=0)

    def compute(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        kind = _CLASS[flat]
        strange = np.add.reduceat(kind == 0, begin) > 1  # more than the space
        # a lead byte C3 has its continuation, as the text is UTF-8, and no other lead byte is a letter here
        starts = kind != 0
        starts[1:] &= kind[1:] != kind[:-1]
        starts[begin] = kind[begin] != 0
        pretokens = np.add.reduceat(starts, begin, dtype=np.int64)
        plain = np.flatnonzero(~strange)
        if len(plain) == len(words):
            return of_plain(flat, pretokens)
        odd = np.flatnonzero(strange)
        a = of_plain(flat[np.repeat(~strange, size)], pretokens[plain]) if len(plain) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        b = encode([words[k] for k in odd.tolist()])
        ids, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(np.concatenate([plain, odd]))
        return ragged(ids, (np.cumsum(n) - n)[order], n[order]), n[order]

    return compute


class WordIds:
    """Words' ids, filled in bulk by `compute`, as arrays.

    Two generations: when the young one holds `most` words or `most_bytes` of them it becomes the old one, and words that come again move
    up, so frequent words stay and memory is bounded whatever the texts hold.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 60_000, most_bytes: int = 4 << 20):
        self.compute, self.most, self.most_bytes = compute, most, most_bytes
        self.young, self.old = self.empty(), self.empty()

    @staticmethod
    def empty() -> dict:
        return {"slot": {}, "bytes": 0, "n": [np.zeros(0, np.int64)], "ids": [np.zeros(0, "<u4")]}

    @staticmethod
    def flat(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first of each slot, number of each slot)."""
        for c in ("n", "ids"):
            g[c] = [np.concatenate(g[c])] if len(g[c]) > 1 else g[c]
        n = g["n"][0]
        return g["ids"][0], np.cumsum(n) - n, n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number): word i has ids[first[i] : first[i] + number[i]]. The words must differ."""
        if len(self.young["slot"]) > self.most or self.young["bytes"] > self.most_bytes:
            self.young, self.old = self.empty(), self.young if self.young["bytes"] <= 4 * self.most_bytes else self.empty()
        g, many = self.young, len(words)
        slot = np.fromiter(map(g["slot"].get, words, repeat(-1)), np.int64, many)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            some = [words[k] for k in missing.tolist()]
            before = np.fromiter(map(self.old["slot"].get, some, repeat(-1)), np.int64, len(some))
            had, new = before >= 0, before < 0
            ids, first, n = self.flat(self.old)
            kept = before[had]
            parts = [(ragged(ids, first[kept], n[kept]), n[kept])]
            if new.any():
                parts.append(self.compute([some[k] for k in np.flatnonzero(new).tolist()]))
            at = missing[np.r_[np.flatnonzero(had), np.flatnonzero(new)]]
            slot[at] = len(g["slot"]) + np.arange(len(at))
            g["slot"].update(zip([words[k] for k in at.tolist()], slot[at].tolist(), strict=True))
            g["bytes"] += sum(map(len, some))
            for ids, n in parts:
                g["ids"].append(ids), g["n"].append(n)
        ids, first, n = self.flat(g)
        return ids, first[slot], n[slot]


def pieces(documents: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, closed by end_id; only longer documents are cut, at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer_words(tokenizer))
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in chunks(texts):
                words = pc.split_pattern(pa.array([x.translate(SPACES) for x in texts[lo:hi]], pa.large_binary()), " ")  # empty words have no ids
                each = words.flatten().dictionary_encode()
                ids, first, n = known.of(as_list(each.dictionary))
                word = each.indices.to_numpy()
                many = np.add.reduceat(n[word], words.offsets.to_numpy()[:-1] - words.offsets[0].as_py())  # a text has one word at least, if an empty one
                # the closing id is one more word at each text's end
                word = np.insert(word, np.cumsum(np.diff(words.offsets.to_numpy())), len(n))
                ids, first, n = np.r_[ids, np.array([end_id], "<u4")], np.r_[first, len(ids)], np.r_[n, 1]
                flat = memoryview(ragged(ids, first[word], n[word]).astype("<u4").tobytes())
                row, piece, start, length, crc, at = [], [], [], [], [], 0
                for i, size in enumerate((many + 1).tolist()):
                    for k, cut_at in enumerate(range(0, size, capacity)):
                        cut = min(capacity, size - cut_at)
                        row.append(i), piece.append(k), start.append(cut_at), length.append(cut), crc.append(zlib.crc32(flat[4 * (at + cut_at) : 4 * (at + cut_at + cut)]))
                    at += size
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = documents.select(F.col(doc_id).alias("doc_id")).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return mapped(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), run, schema)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most capacity ids: one row per piece with sequence_id and offset."""
    return best_fit(pinned(pieces(documents, tokenizer, capacity=capacity)), capacity=capacity)
