"""Online packing of documents into windows of fixed capacity by sums of squares.

A level array holds, for each fill level, how many open windows have it. A document (behind its whole windows, which are cut off first)
goes where it makes the sum of the squared counts of partly filled windows smallest: into an open window of some level, or into a new one
(ties: the fullest level; a new window last). Documents are taken as the table is read, so nothing is shuffled: each task packs the rows of
its partition, and a sequence never has rows of two tasks.

Documents are whole unless a window must be closed otherwise: when more than OPEN windows are open, and at a task's end, the emptiest
windows' pieces fill the gaps of the fullest, cut where they don't fit. All but one are then full. The last one of a task is dealt into
sequences of powers of two, its pieces cut at their borders, so no sequence has any padding. A task holds the ids of its open windows and
of one chunk of texts.

Ids are those of the tokenizer: a text is cut before every space that begins one of its pre-tokens, and such units are encoded once and
remembered (the most frequent ones). Null text is empty; a document always has its closing id. Null or repeated ids are ordinary rows.
Very long texts are ordinary ones. Only the named columns are read, whatever the others are called. Empty tables give an empty result. Rows
come in the order in which they are read: a task that runs again gives the same rows only from a table, a checkpoint or another fixed order.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, mapped
from .packing import _CLASS, WordIds, as_list, byte_letters, ragged

CAPACITY = 2048
OPEN = 2_000  # open windows of a task, 16 MB of ids at most
UNITS = 150_000  # remembered units of a worker, twice at most

#: White space of the pre-tokens' pattern (Unicode's White_Space), as code points and in UTF-8.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ONE, _TWO, _THREE = rb"[\t-\r ]", rb"\xc2[\x85\xa0]", rb"(?:\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
#: A space inside a run of white space: no pre-token begins there.
_INNER = re.compile(rb"(?:(?<=" + _ONE + rb")|(?<=" + _TWO + rb")|(?<=" + _THREE + rb")) (?=" + _ONE + rb"|" + _TWO + rb"|" + _THREE + rb"|\Z)")
_ENDS = tuple(chr(c).encode() for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Bytes that no text has: ahead of a text's first unit; for spaces that don't part units; ahead of a unit that follows without a space.
_FIRST, _HELD, _CLOSE = b"\xff", b"\xfe", b"\xfd"
#: 1 for ASCII letters and digits, 2 for marks but the apostrophe, which may begin a pre-token of letters.
_KIND = np.array([1 if chr(b).isascii() and chr(b).isalnum() else 2 if chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else 0 for b in range(256)], dtype=np.uint8)


class Levels:
    """Counts of open windows by fill level, and the choice that keeps their sum of squares smallest."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)  # levels 0 and capacity stay 0: no window there is partly filled

    def choose(self, size: int) -> int:
        """The level of the window that a document of 1 to capacity - 1 ids goes into; 0 for a new window."""
        n, top = self.counts, self.capacity
        here = n[1 : top - size + 1]
        change = n[size + 1 :] - here  # half the change of the sum, less one
        change[-1:] *= 2
        change[:-1] = 2 * change[:-1] + 2
        change[-1:] += 1  # a full window leaves one level and enters none
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(change[::-1].argmin())
        return best + 1 if change[best] <= 2 * n[size] + 1 and here[best] else 0

    def move(self, before: int, after: int) -> None:
        if before:
            self.counts[before] -= 1
        if after < self.capacity:
            self.counts[after] += 1


class Windows:
    """The open windows of a task. A piece is [document's number, start, ids]; `out` gets (piece, sequence, offset) of closed ones."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, most: int = OPEN):
        self.levels, self.next_id, self.most, self.open = Levels(capacity), first_id, most, 0
        self.at: list[list[list]] = [[] for _ in range(capacity)]  # windows (lists of pieces) by level
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((piece, self.next_id, offset))
            offset += len(piece[2])
        self.next_id += 1

    def add(self, document: int, ids: np.ndarray) -> None:
        top = self.levels.capacity
        rest = len(ids) % top
        for k in range(0, len(ids) - rest, top):
            self.close([[document, k, ids[k : k + top]]])
        if rest:
            level = self.levels.choose(rest)
            window = self.at[level].pop() if level else []
            window.append([document, len(ids) - rest, ids[len(ids) - rest :]])
            self.open += not level
            self.put(window, level, level + rest)
            if self.open > self.most:
                self.settle()

    def put(self, window: list, before: int, after: int) -> None:
        self.levels.move(before, after)
        if after == self.levels.capacity:
            self.close(window)
            self.open -= 1
        else:
            self.at[after].append(window)

    def settle(self) -> None:
        """Close all open windows but one at most: pieces of the emptiest fill the fullest."""
        top = self.levels.capacity
        held = [w for level in reversed(self.at) for w in level]
        self.at = [[] for _ in range(top)]
        self.levels.counts[:] = 0
        self.open = 0
        i, j = 0, len(held) - 1
        while i <= j:
            gap = top - sum(len(p[2]) for p in held[i])
            while gap and i < j:
                document, start, ids = held[j].pop()
                held[i].append([document, start, ids[:gap]])
                if len(ids) > gap:
                    held[j].append([document, start + gap, ids[gap:]])
                gap -= min(gap, len(ids))
                j -= not held[j]
            if gap == 0:
                self.close(held[i])
            elif held[i]:
                self.open += 1
                self.put(held[i], 0, top - gap)
            i += 1

    def finish(self) -> None:
        """Settle, and deal the last window into sequences of powers of two."""
        self.settle()
        for level, windows in enumerate(self.at):
            for pieces in windows:
                for size in (1 << k for k in range(level.bit_length() - 1, -1, -1) if level >> k & 1):
                    taken = []
                    while size:
                        document, start, ids = pieces.pop(0)
                        taken.append([document, start, ids[:size]])
                        if len(ids) > size:
                            pieces.insert(0, [document, start + size, ids[size:]])
                        size -= min(size, len(ids))
                    self.close(taken)
        self.at, self.open = [[] for _ in range(self.levels.capacity)], 0
        self.levels.counts[:] = 0


def units(texts: list[bytes]) -> pa.DictionaryArray:
    """The texts' units, one after another. Each text's first unit begins with _FIRST; one that has no space ahead, with _CLOSE.

    Cuts are made before each space that begins a pre-token, and between an ASCII letter or digit and a mark.
    """
    runs = pc.match_substring_regex(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False), f"{_SPACE} (?:{_SPACE}|$)").to_pylist()
    flat = np.frombuffer(b" ".join(_FIRST + (_INNER.sub(_HELD, b"." + x)[1:] if odd else x) for x, odd in zip(texts, runs, strict=True)), dtype=np.uint8)
    kind = _KIND[flat]
    cuts = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    flat = np.insert(flat, np.repeat(cuts, 2), np.tile(np.frombuffer(b" " + _CLOSE, np.uint8), len(cuts)))
    return pc.split_pattern(pa.array([flat.tobytes()], pa.large_binary()), " ").flatten().dictionary_encode()


def text_ids(path: str, end_id: int) -> Callable[[list[bytes]], list[np.ndarray]]:
    """texts -> the ids of each by a byte-level tokenizer, with end_id behind them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    full, bare, letters = tokenizer.pre_tokenizer, pre_tokenizers.WhitespaceSplit(), byte_letters()
    space = chr(256 + 32)  # the letter of a space's byte
    sizes = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(token)  # a letter stands for a byte

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(texts: list[str], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As compute, of words that are joined in texts with a space ahead of each: the ids are cut by their bytes."""
        ids = np.concatenate(encode(texts))
        ends, want = np.cumsum(sizes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = np.searchsorted(ends, want)
        if (ends[at] != want).any():
            raise ValueError("the vocabulary's ids don't follow its pre-tokens")
        return ids, np.diff(at + 1, prepend=0)

    def of_letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of units of letters alone: each is one pre-token, so the pattern isn't asked."""
        texts = [letters[np.frombuffer(b" ".join(words[k : k + 1000]), np.uint8)].tobytes().decode("utf-32-le") for k in range(0, len(words), 1000)]
        tokenizer.pre_tokenizer = bare
        try:
            return cut([space + x.replace(" ", " " + space) for x in texts], words)
        finally:
            tokenizer.pre_tokenizer = full

    def of_plain(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of units that begin and end a pre-token wherever they stand."""
        return cut([(b" " + b" ".join(words[k : k + 1000])).decode() for k in range(0, len(words), 1000)], words)

    def of_odd(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = encode([text_of(w) for w in words])
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def compute(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        kind = np.where((size == 0) | (flat[begin] >= 0xFD) | (np.add.reduceat(flat == 0xFE, begin) > 0) | (flat[begin + size - 1] <= 32), 2, 1)
        kind[(np.add.reduceat(_CLASS[flat] != 1, begin) == 1) & (kind == 1)] = 0  # the space behind it alone
        for k in np.flatnonzero((kind == 1) & (flat[begin + size - 1] >= 0x80)).tolist():
            kind[k] += words[k].endswith(_ENDS)
        parts, order = [], []
        for which, run in enumerate((of_letters, of_plain, of_odd)):
            at = np.flatnonzero(kind == which)
            if len(at):
                try:
                    parts.append(run([words[k] for k in at.tolist()]))
                except UnicodeDecodeError:  # not UTF-8: one by one
                    parts.append(of_odd([words[k] for k in at.tolist()]))
                order.append(at)
        ids, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        back = np.argsort(np.concatenate(order))
        return ragged(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    def text_of(unit: bytes) -> str:
        return (unit[1:] if unit[:1] in (_FIRST, _CLOSE) else b" " + unit).replace(_HELD, b" ").decode("utf-8", "replace")

    def of_texts(texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts with special tokens: around those, white space is cut otherwise."""
        return encode([x.decode("utf-8", "replace") for x in texts])

    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    known = WordIds(compute, UNITS)

    def of(texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids with end_id behind them."""
        whole = {k: None for k, x in enumerate(texts) if any(s in x for s in special)}
        each = units([b"" if k in whole else x for k, x in enumerate(texts)])
        words = as_list(each.dictionary)
        ids, first, n = known.of(words)
        word = each.indices.to_numpy()
        starts = np.flatnonzero(np.fromiter((w[:1] == _FIRST for w in words), bool, len(words))[word])
        word = np.insert(word, np.r_[starts[1:], len(word)], len(n))  # the closing id is one more unit at each text's end
        ids, first, n = np.r_[ids, np.array([end_id], "<u4")], np.r_[first, len(ids)], np.r_[n, 1]
        found = np.split(ragged(ids, first[word], n[word]).astype("<u4"), np.cumsum(np.add.reduceat(n[word], starts + np.arange(len(starts))))[:-1])
        for k, x in zip(whole, of_texts([texts[k] for k in whole]) if whole else [], strict=True):
            found[k] = np.r_[x, np.array([end_id], "<u4")]
        return found

    return of


def pack_online(documents: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1, most_open: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    tokenizer: a byte-level vocabulary whose pre-tokens hold one leading space at most. capacity: a power of two, or the task's last window
    is cut all the same, into powers of two.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(tokenizer, end_id)
        windows = Windows(TaskContext.get().partitionId() << 33, capacity, most_open)
        documents_: dict[int, list] = {}  # id, ids in all, ids not yet in a closed window
        number, kind = 0, None

        def closed() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for (document, start, ids), sequence, offset in windows.out:
                entry = documents_[document]
                entry[2] -= len(ids)
                for column, value in zip(columns, (entry[0], start, len(ids), zlib.crc32(ids.tobytes()), entry[1], sequence, offset), strict=True):
                    column.append(value)
                if not entry[2]:
                    del documents_[document]
            windows.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for b in batches:
            kind, texts, keys = b.column(0).type, as_bytes(b.column(1)), b.column(0).to_pylist()
            for lo, hi in chunks(texts):
                for key, ids in zip(keys[lo:hi], ids_of(texts[lo:hi]), strict=True):
                    documents_[number] = [key, len(ids), len(ids)]
                    # what stays open must not hold the chunk
                    windows.add(number, ids.copy())
                    number += 1
                if windows.out:
                    yield closed()
        windows.finish()
        if windows.out:
            yield closed()

    schema = documents.select(F.col(doc_id).alias("doc_id")).schema
    for name in names[1:]:
        schema = schema.add(name, "long")
    return mapped(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), run, schema)
