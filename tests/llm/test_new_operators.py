"""Online packing, source divergence and conversation repair against brute force on small tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from twinfold.llm import divergence, online, repair
from twinfold.llm.common import table
from twinfold.llm.queries import oracle_sql, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, length long, sequence_id string, term string, n int, block string"
BYTES = "byte_bpe_50k.json"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1, "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    long = " ".join(f"word{i % 701} talks." for i in range(12_000))
    return [(1, "a small text, here.", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, long, "en", "s2"), (4, long, "en", "s2"), (5, "a small text, here.", None, "s1"), (None, "no id but words", "en", "s1"), (6, "éà ñandú\n\n\nüber", "de", None), (7, "1234 !!", "en", "s3"), (8, " \t\n", "en", "s3"), (9, "a <|endoftext|>  b", "fr", "s4")]


# ---- 11 online packing


@pytest.mark.parametrize("capacity", [8, 64])
def test_levels_choose_the_least_sum_of_squares(capacity):
    rng = random.Random(capacity)
    levels = online.Levels(capacity)
    for _ in range(2_000):
        size = rng.randrange(1, capacity)
        costs = {}
        for level in range(capacity - size + 1):
            if level == 0 or levels.counts[level]:
                after = levels.counts.copy()
                after[level] -= level > 0
                if level + size < capacity:
                    after[level + size] += 1
                costs[level] = int((after**2).sum())
        chosen = levels.choose(size)
        assert costs[chosen] == min(costs.values()) and (chosen == max(k for k in costs if costs[k] == costs[chosen]))
        levels.move(chosen, chosen + size)


@pytest.mark.parametrize("most", [3, 2_000])
def test_windows_are_full_and_whole(most):
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 200, 700), np.full(300, 40), np.full(50, 64), np.array([33]), np.array([1])):
        w = online.Windows(10, 64, most)
        texts = {k: rng.integers(0, 9, n).astype("<u4") for k, n in enumerate(sizes.tolist())}
        for k, ids in texts.items():
            w.add(k, ids)
            assert w.open <= most and w.open == sum(map(len, w.at)) == w.levels.counts.sum()
        w.finish()
        own, fills = defaultdict(dict), Counter()
        for (k, start, ids), sequence, offset in w.out:
            assert offset == fills[sequence]  # pieces come in order
            fills[sequence] += len(ids)
            own[k][start] = ids
        assert all(np.array_equal(np.concatenate([own[k][s] for s in sorted(own[k])]), ids) for k, ids in texts.items())
        assert all(f == 64 or f & (f - 1) == 0 for f in fills.values()) and sum(f < 64 for f in fills.values()) <= 6
        assert sorted(fills) == list(range(10, 10 + len(fills)))


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(BYTES))
    texts = ["", " ", "  ", "a  b", "a   b ", "  a", "\n\nb", "a \n b", "x  <|endoftext|>  y", "it's we'll  I'm", "a   b", "　 a", "a\x1c \x1c b", "\u0085 \u0085 c", "日本 語  x", "a \t \t  b", " 1 22  333,4", "!! ??  ..", "É é. don't, x'S", "end "]
    rng = random.Random(1)
    letters = [" ", " ", "\n", "a", "B", "1", "!", "'s", ",", " ", " ", "é", "<|endoftext|>", "\t", "\x1c", "\x85"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(4_000)]
    got = online.text_ids(tokenizer_path(BYTES), 1)([x.encode() for x in texts])
    assert [g.tolist() for g in got] == [[*tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def check_online(rows, texts):
    """rows: of pack_online; texts: (doc_id, text) of all documents."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(BYTES))
    fills, want, got = defaultdict(list), Counter(), defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in fills.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # none has padding
    for i, x in texts:
        ids = np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[i, len(ids)] += len(ids)
        assert any(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in got[i, len(ids)])
        if sum(1 for j, y in texts if j == i) == 1:
            at = 0
            for s, n, c in sorted(got[i, len(ids)]):
                assert s == at and zlib.crc32(ids[s : s + n].tobytes()) == c
                at += n
            assert at == len(ids)
    assert {k: sum(n for _, n, _ in v) for k, v in got.items()} == want


def test_online_packing_of_the_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = online.pack_online(docs, tokenizer_path(BYTES)).collect()
    check_online(rows, [(r.doc_id, r.text) for r in docs.collect()])
    least = sum(-(-r.doc_tokens // 2048) for r in rows if r.start == 0)
    assert least <= len(rows) < least + 0.5 * docs.count()  # cuts beyond those of long documents: at the end of the table alone


def test_online_packing_edges(spark, odd_rows):
    odd = docs_frame(spark, odd_rows).coalesce(1)
    for most in (1, 2_000):
        check_online(online.pack_online(odd, tokenizer_path(BYTES), most_open=most).collect(), [r[:2] for r in odd_rows])
    empty = online.pack_online(docs_frame(spark, []), tokenizer_path(BYTES))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# ---- 12 source divergence


def divergence_by_hand(rows, least=30, top=50):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for (x, s), c in counts.items():
            if x == lang:
                total = sum(c[t] for t in kept) + 5 * len(kept)
                p[s] = {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        all_ = {t: sum(c[t] for (x, _), c in counts.items() if x == lang) for t in kept}
        total = sum(all_.values()) + 5 * len(kept)
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in p if s != source]
        terms = [(t, p[source][t] - 1 - 10**9 * (all_[t] + 5) // total) for t in kept if own[t]]
        for part, found, most in (("pair", pairs, None), ("term", [x for x in terms if x[1] > 0], top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def test_divergence_equals_counting_by_hand(spark, monkeypatch, odd_rows):
    rng = random.Random(2)
    words = ["ab", "ÉCLAIR", "x1y", "Zed", "日本", "q'r", "ß", "wort", "Haus", "it"]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(0, 12))), rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(9)] + [None])) for i in range(400)] + odd_rows
    want = divergence_by_hand(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    frame = docs_frame(spark, rows)
    got = divergence.audit(frame).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    for name, value in (("SOURCES", 3), ("BLOCK", 2), ("HELD", 5)):  # chunks of sources, blocks of terms, rows combined in parts
        monkeypatch.setattr(divergence, name, value)
    assert {tuple(r) for r in divergence.audit(frame).collect()} == want


def test_divergence_edges(spark, odd_rows):
    assert divergence.audit(docs_frame(spark, [])).count() == 0
    got = {tuple(r) for r in divergence.audit(docs_frame(spark, odd_rows)).collect()}
    assert got == divergence_by_hand(odd_rows) and {r[4] for r in got} == {0}  # no term is kept: all pairs are there with 0


def test_run_lengths():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 3, 40), rng.integers(0, 3, 40)
        coded = [divergence.run_length(np.flatnonzero(x), x[x > 0], 40) for x in (a, b)]
        assert divergence.difference(*coded, 40) == np.abs(a - b).sum()
        assert all(len(c[0]) == 1 + (np.diff(x) != 0).sum() for c, x in zip(coded, (a, b), strict=True))
    for total in (7, 10**15 - 3):
        for count in (0, 1, total // 3, total - 1, total):
            assert divergence.shares(np.array([count]), total)[0] == 1 + 10**9 * count // total


def test_share_column_is_exact(spark):
    rows = [(c, t) for t in (7, 999_983, 8 * 10**15) for c in (0, 1, t // 3, t - 1, t)]
    frame = spark.createDataFrame(rows, "c long, t long")
    from pyspark.sql import functions as F

    assert [r[0] for r in frame.select(divergence.share(F.col("c"), F.col("t"))).collect()] == [1 + 10**9 * c // t for c, t in rows]


# ---- 13 conversation repair


def cheapest_by_search(rows, faults):
    """(cost, audit, repaired rows) by the first that a search by (cost, audit) completes."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        state = {"": 0, "s": 1}.get(roles, 2 if roles.endswith("u") else 3)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, kept

        def go(letter, price, initial, row, used):
            if re.fullmatch("s?(ua)*u?", roles + initial):  # noqa: B023
                heapq.heappush(heap, (cost + price, audit + letter, i + used, roles + initial, kept + row))  # noqa: B023

        for initial, role in (("u", "user"), ("a", "assistant")):
            go("I", 3, initial, ((role, ""),), 0)
        if i < len(rows):
            _, role, text = rows[i]
            more = 3 * (faults[i] == "truncated")
            go("D", 4, "", (), 1)
            if faults[i] in ("ok", "truncated"):
                if role[:1] and role[0] in "sua":
                    go("K", more, role[0], ((role, text),), 1)
                for initial, name in (("u", "user"), ("a", "assistant")):
                    go("R", 3 + more, initial, ((name, text),), 1)


def repaired_by_hand(rows):
    kept = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(kept[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {r[0] for r in own} - {None}
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip("\t\n\x0b\x0c\r ")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, left = cheapest_by_search(own, faults)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def check_repair(frame):
    got = repair.repaired(frame).collect()
    want = repaired_by_hand([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_repair_of_the_table(spark, tiny):
    check_repair(table(spark, tiny, "conversations"))


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, kind int, symbol string"


def conversations_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(250), None]:
        for _ in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 4, 5, 7, -3]), rng.choice([None, "user", "assistant", "system", "tool", "", "User", "u", "a"]), rng.choice([None, "", " ", "A b.", "A b", "Hi!", "so?\n", "x ", "é", "日本。"])))
    # long conversations span ranges: one row again and again, and one of many texts
    rows += [(999, i // 3, "user", "same.") for i in range(2_500)] + [(998, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", ""]) + str(rng.randrange(3))) for i in range(1_500)]
    rows += [(997, 1, "user", "a long text. " * 20_000)]
    check_repair(conversations_frame(spark, rows))
    assert repair.repaired(conversations_frame(spark, [])).count() == 0


def test_pieces_of_a_conversation_are_joined(spark, monkeypatch):
    monkeypatch.setattr(repair, "RUNS", 2)
    monkeypatch.setattr(repair, "SPAN", 3)
    rng = random.Random(6)
    check_repair(conversations_frame(spark, [(c, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", ""]) + str(rng.randrange(9))) for c in range(20) for t in range(30)]))


def test_powers_equal_steps():
    rng = np.random.default_rng(2)
    for symbol in range(16):
        for n in (1, 2, 7, 100):
            end = rng.integers(0, 30, 4)
            step = end
            for _ in range(n):
                step = repair.advanced(symbol, 1, step)
            assert repair.advanced(symbol, n, end).tolist() == step.tolist()


def test_long_runs():
    """Runs far longer than a span give the same as rows one by one."""
    for symbol in (0, 4, 5, 7, 12):
        cost, audit = repair.cheapest([(symbol, 5_000)])
        assert (cost, audit) == repair.cheapest([(symbol, 1)] * 5_000)
    assert oracle_sql()["op12_source_divergence"]
