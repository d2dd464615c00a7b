"""Conversation structure repair: the cheapest edits that make a conversation's roles an optional system turn and user/assistant pairs.

Each row becomes a symbol, its role's initial with its fault. Rows are sorted by range of (conversation, turn, role, text's md5), in which a
long conversation spans many tasks, and each task collapses runs of equal symbols; what comes together for a conversation is its runs. A
symbol is a min-plus transition between the four states of the wanted form; a run is advanced through cached binary powers of its
transition, from the conversation's end to its start, so each run's border has its costs to go. The audit is then unrolled forwards, the
run's rows in blocks whose own borders come from the same powers: at each place the least letter among the cheapest edits. A last pass
streams each conversation's texts in order behind its audit and hashes what remains, so no conversation's text is held as a whole.

Faults: a row is blank without any text but white space; else a duplicate if role and text came earlier in its conversation; else truncated
if its last character isn't one of `.!?`. Nulls: a null role or text is one space, in `conv_id:turn` a null is one space too; null turns sort
first; a null conv_id is a conversation of its own. Rows of one turn sort by role and the text's md5; repeated rows are duplicates. Very long
texts are ordinary. Only the named columns are read, whatever the others are called. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, pinned

WHITE = "\t\n\x0b\x0c\r "
MARKS = ".!?"
#: Costs of the edits (fixed values of the contract) and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("ok", "truncated", "duplicate", "blank")
INITIALS = "sua"  # others are as one
#: States of the wanted form: nothing yet, behind s, behind u, behind a. The state that an initial leads to; ends are states 0 and 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")  # what a state takes next where no system turn is given
FAR = 1 << 60
SPAN = 1024  # rows of a run that are unrolled at once
RUNS = 50_000  # runs in one row, at most


# ---- damage


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(`conv_id:turn`) % 20 deals."""
    named = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    rows = named.withColumn("kind", kind).filter("kind <> 0").withColumn("text", changed).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def order_of(turn: str = "turn") -> list[Column]:
    return [F.col(turn).asc_nulls_first(), F.col("role").asc(), F.col("md5").asc()]


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, md5, symbol, n: rows that are alike with how many they are; their repetitions in rows of their own (later = 1).

    A symbol is 4 x the initial's place (3 for others) + the fault's place.
    """
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(len(INITIALS)))
    initial = F.when(F.col("role") == "", len(INITIALS)).otherwise(initial)
    fault = F.when(bare == "", 3).when(F.substring(bare, -1, 1).isin(*MARKS), 0).otherwise(1)
    keys = ["conv_id", "role", "md5"]
    alike = rows.select("conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("md5"), initial.cast("int").alias("initial"), fault.alias("fault")).groupBy("conv_id", "turn", "role", "md5", "initial", "fault").agg(F.count("*").alias("n"))
    alike = pinned(alike)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # role and text seen at an earlier turn; a text that every turn repeats is one row here, and its rows are dealt anew where they are many
    first = alike.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("md5").alias("m"), "first")
    seen = alike.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("md5") == F.col("m")), "left")
    again = F.coalesce(place > F.col("first"), F.lit(False))
    own = F.when((F.col("fault") < 3) & again, 2).otherwise(F.col("fault"))
    rest = F.when(F.col("fault") < 3, 2).otherwise(F.col("fault"))
    both = F.filter(F.array(F.struct(F.lit(0).alias("later"), (F.col("initial") * 4 + own).cast("int").alias("symbol"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(1).alias("later"), (F.col("initial") * 4 + rest).cast("int").alias("symbol"), (F.col("n") - 1).alias("n"))), lambda s: s["n"] > 0)
    return seen.select("conv_id", "turn", "role", "md5", F.explode(both).alias("s")).select("conv_id", "turn", "role", "md5", "s.*")


def runs(marked: DataFrame) -> DataFrame:
    """conv_id and its pieces, in order: (part, no, first turn, last turn, turns, symbols, counts) of at most RUNS runs each."""
    ordered = marked.repartitionByRange(F.col("conv_id").asc_nulls_first(), *order_of(), F.col("later").asc()).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order_of(), F.col("later").asc())
    ordered = ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("symbol").cast("long"), "n", F.spark_partition_id().alias("part"))
    names = ["conv_id", "part", "no", "first_turn", "last_turn", "turns", "symbols", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        no, out, kind = 0, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            kind = b.column(0).type
            for conv_id, turn, symbol, n, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or held[0] != conv_id or len(held[6]) >= RUNS:
                    if held is not None:
                        out.append(held)
                    held = [conv_id, part, no, None, None, 0, [], []]
                    no += 1
                if turn is not None and turn != held[4]:
                    held[3] = turn if held[3] is None else held[3]
                    held[4] = turn
                    held[5] += 1
                if held[6] and held[6][-1] == symbol:
                    held[7][-1] += n
                else:
                    held[6].append(symbol)
                    held[7].append(n)
            if out:
                yield batch()
        if held is not None:
            out.append(held)
            yield batch()

    schema = marked.select("conv_id").schema
    for name, dtype in zip(names[1:], ("integer", *["long"] * 4, *[T.ArrayType(T.LongType())] * 2), strict=True):
        schema = schema.add(name, dtype)
    pieces = mapped(ordered, run, schema)
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("pieces"))


# ---- the cheapest edits


def _closed(m: np.ndarray) -> np.ndarray:
    """m with insertions ahead of it: rows are states before, columns behind."""
    for _ in range(2):  # a third insertion would undo nothing that two can't
        ahead = np.stack([m[STEP[s, WANTED[s]]] for s in range(4)]) + INSERT
        m = np.minimum(m, ahead)
    return np.minimum(m, FAR)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> np.ndarray:
    """The min-plus transition of 2^k rows of a symbol, 4 x 4."""
    if k:
        half = power(symbol, k - 1)
        return np.minimum((half[:, :, None] + half[None, :, :]).min(axis=1), FAR)
    m = np.full((4, 4), FAR, dtype=np.int64)
    for s in range(4):
        for _, cost, to in row_edits(symbol, s):
            m[s, to] = min(m[s, to], cost)
    return _closed(m)


@lru_cache(maxsize=None)
def row_edits(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits that use up a row, by letter."""
    initial, fault = divmod(symbol, 4)
    found = [("D", DELETE, state)]
    if fault < 2:
        if initial < len(INITIALS) and (state, INITIALS[initial]) in STEP:
            found.append(("K", TRUNCATED * fault, STEP[state, INITIALS[initial]]))
        found.append(("R", REROLE + TRUNCATED * fault, STEP[state, WANTED[state]]))
    return tuple(found)


def advanced(symbol: int, n: int, to_go: np.ndarray) -> np.ndarray:
    """Costs to go ahead of n rows of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            to_go = np.minimum((power(symbol, k) + to_go).min(axis=1), FAR)
        n, k = n >> 1, k + 1
    return to_go


def at_end() -> np.ndarray:
    return _closed(np.array([[0], [FAR], [FAR], [0]], dtype=np.int64))[:, 0]


def cheapest(coded: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's runs (symbol, rows)."""
    borders = [at_end()]
    for symbol, n in reversed(coded):
        borders.append(advanced(symbol, n, borders[-1]))
    borders.reverse()
    cost, state, audit = int(borders[0][0]), 0, []

    def inserted(left: int) -> int:
        """The state behind an insertion if one is on a cheapest way; letters of row edits below I were refused before."""
        nonlocal state
        audit.append("I")
        state = STEP[state, WANTED[state]]
        return left - INSERT

    left = cost
    for (symbol, n), behind in zip(coded, borders[1:], strict=True):
        while n:
            span = min(n, SPAN)
            ahead = [advanced(symbol, n - span, behind)]  # costs to go behind the span's rows, the last first
            for _ in range(span - 1):
                ahead.append(advanced(symbol, 1, ahead[-1]))
            one = [v.tolist() for v in ahead]
            for costs in reversed(one):
                own = costs  # costs to go behind this row
                while True:
                    if own[state] + DELETE == left:
                        audit.append("D")
                        left -= DELETE
                        break
                    nxt = STEP[state, WANTED[state]]
                    if INSERT + min(price + own[to] for _, price, to in row_edits(symbol, nxt)) == left or INSERT * 2 + min(price + own[to] for _, price, to in row_edits(symbol, STEP[nxt, WANTED[nxt]])) == left:
                        left = inserted(left)
                        continue
                    letter, price, to = next(e for e in row_edits(symbol, state) if e[1] + own[e[2]] == left)
                    audit.append(letter)
                    left, state = left - price, to
                    break
            n -= span
    while left:
        left = inserted(left)
    return cost, "".join(audit)


def illegal_pairs(coded: list[tuple[int, int]]) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    initials = [(INITIALS + "?")[s // 4] for s, _ in coded]
    return sum(n - 1 for _, n in coded) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def diagnosed(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit from `runs`."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for pieces in b.column(1).to_pylist():
                coded: list[tuple[int, int]] = []
                faults = [0, 0, 0, 0]
                low = high = None
                turns = 0
                for p in pieces:
                    for symbol, n in zip(p["symbols"], p["counts"], strict=True):
                        faults[symbol % 4] += n
                        if coded and coded[-1][0] == symbol:
                            n += coded.pop()[1]
                        coded.append((symbol, n))
                    if p["turns"]:
                        turns += p["turns"] - (high == p["first_turn"])  # a turn on both sides of a border counts once
                        low, high = p["first_turn"] if low is None else low, p["last_turn"]
                found.append((high - low + 1 - turns if turns else 0, faults[3], faults[2], faults[1], illegal_pairs(coded), *cheapest(coded)))
            columns = list(zip(*found, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())], names)

    schema = conversations.select("conv_id").schema
    for name in names[1:]:
        schema = schema.add(name, "string" if name == "audit" else "long")
    return mapped(conversations, run, schema)


# ---- what remains


class Remains:
    """A conversation's repaired rows, fed in order and hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, 0, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.any = True
        self.sha.update(f"{role}:".encode())
        self.sha.update(text.encode())
        self.state = STEP[self.state, role[0]]

    def wanted(self) -> str:
        return {"u": "user", "a": "assistant"}[WANTED[self.state]]

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(self.wanted(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self.put(role if letter == "K" else self.wanted(), text)

    def digest(self) -> str:
        self.insertions()
        if self.at != len(self.audit):
            raise ValueError("a conversation's rows are not those of its audit")
        return self.sha.hexdigest()


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation of the table."""
    rows = damaged(conversations, conv_id, turn, role, text)
    found = pinned(diagnosed(runs(symbols(rows))))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("md5", "string"), ("text", "string"))]
    none = [F.lit(None).cast("long").alias(c) for c in counts]
    every = conversations.select(F.col(conv_id).alias("conv_id")).distinct().select("conv_id", F.lit(0).alias("kind"), *nothing, *none, F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(1).alias("kind"), *nothing, *counts, "audit")
    texts = rows.select("conv_id", F.lit(2).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", F.md5(F.encode("text", "UTF-8")).alias("md5"), "text", *none, F.lit(None).cast("string").alias("audit"))
    # a hash is taken of one text from its start: a conversation's rows pass one task, as a stream
    stream = every.unionByName(heads).unionByName(texts).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order_of())
    stream = stream.select("conv_id", "kind", "role", "text", *counts, "audit")
    names = ["conv_id", *counts, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None  # (conv_id, counts, audit, remains)
        out: list[tuple] = []
        kind_ = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind_, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names)

        for b in batches:
            kind_ = b.column(0).type
            for key, kind, role_, text_, *figures, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    if now:
                        out.append((now[0], *now[1], now[2], now[3].digest()))
                    now = (key, [0] * 6, "", Remains(""))
                elif kind == 1:
                    now = (key, figures, audit, Remains(audit))
                else:
                    now[3].row(role_, text_)
            if out:
                yield batch()
        if now:
            out.append((now[0], *now[1], now[2], now[3].digest()))
            yield batch()

    schema = stream.select("conv_id").schema
    for name in names[1:]:
        schema = schema.add(name, "long" if name in counts else "string")
    return mapped(stream, run, schema)
