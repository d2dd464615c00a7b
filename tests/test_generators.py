"""Generators, lineage graphs and token pairs against plain loops."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from twinfold.operators import design, lineage, resample, tokens
from twinfold.operators.checks import ValidationError


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("room", [40, 90, 400])
def test_rows_with_two_signatures_are_as_if_drawn_one_by_one(spark, room):
    n = 30
    keys = lambda i, a: F.array(F.concat(F.lit("t"), resample.md5_number(F.lit("t"), i, a) % room), F.concat(F.lit("h"), resample.md5_number(F.lit("h"), i, a) % (2 * room)))
    used = spark.createDataFrame([("t3",), ("h5",), ("t3",)], "signature string")
    seen, want = {"t3", "h5"}, {}
    for i in range(n):
        for a in range(1_000):
            own = [f"t{number('t', i, a) % room}", f"h{number('h', i, a) % (2 * room)}"]
            if not seen & {*own}:
                seen |= {*own}
                want[i] = (a, own)
                break
    got = {r.i: (r.attempt, r["keys"]) for r in design.fresh_keyed(spark.range(n).select(F.col("id").alias("i")).repartition(3), "i", keys, used).collect()}
    assert got == want and (room > 90 or max(a for a, _ in want.values()) > 1)


def test_no_fresh_signature_raises(spark):
    with pytest.raises(ValueError, match="no fresh signature"):
        design.fresh_keyed(spark.range(3).select(F.col("id").alias("i")), "i", lambda i, a: F.array(F.lit("x")), spark.createDataFrame([], "signature string"), 8)
    assert design.fresh_keyed(spark.range(0).select(F.col("id").alias("i")), "i", lambda i, a: F.array(F.lit("x")), spark.createDataFrame([], "signature string")).count() == 0


def test_rows_without_conflicts_ask_for_one_attempt_alone(spark):
    """Work follows the attempts that are needed: here the second ones of two rows, whose first are used or another's, and no third one."""
    keys = lambda i, a: F.when(a > F.when(i.isin(3, 7), 1).otherwise(0), F.raise_error("asked for more")).otherwise(F.array(F.concat_ws("-", F.when((i == 7) & (a == 0), 5).otherwise(i), a)))
    got = design.fresh_keyed(spark.range(20).select(F.col("id").alias("i")), "i", keys, spark.createDataFrame([("3-0",), (None,)], "signature string")).collect()
    assert {r.i: (r.attempt, r["keys"]) for r in got} == {i: (int(i in (3, 7)), [f"{i}-{int(i in (3, 7))}"]) for i in range(20)}


def test_rows_that_run_out_of_attempts_in_passing_go_on(spark):
    """Row 2 has no free attempt while row 1 holds m, which row 1 gives up since row 0 has k."""
    keys = lambda i, a: F.when(i == 0, F.array(F.lit("k"))).when(i == 1, F.when(a == 0, F.array(F.lit("k"), F.lit("m"))).otherwise(F.array(F.lit("z")))).otherwise(F.when(a == 0, F.array(F.lit("m"))).otherwise(F.array(F.lit("k"))))
    got = design.fresh_keyed(spark.range(3).select(F.col("id").alias("i")), "i", keys, spark.createDataFrame([], "signature string"), 4).collect()
    assert {r.i: (r.attempt, r["keys"]) for r in got} == {0: (0, ["k"]), 1: (1, ["z"]), 2: (0, ["m"])}


def test_keys_are_made_once(spark):
    """However many rounds follow: all 20 rows' first keys and, as these are one, second keys of 19."""
    made = spark.sparkContext.accumulator(0)

    def key(i, a):
        made.add(1)
        return f"{i}-{a}" if a else "first"

    asked = F.udf(key, "string")
    got = design.fresh_keyed(spark.range(20).select(F.col("id").alias("i")), "i", lambda i, a: F.array(asked(i, a)), spark.createDataFrame([], "signature string")).collect()
    assert {r.i: r.attempt for r in got} == {i: int(i > 0) for i in range(20)} and made.value == 39


def test_rows_that_share_an_index_share_their_keys_and_none_lacks_one(spark):
    frame, none = lambda ids: spark.createDataFrame([(i,) for i in ids], "i long"), spark.createDataFrame([], "signature string")
    keys = lambda i, a: F.array(F.when((i == 2) & (a == 0), "1-0").otherwise(F.concat_ws("-", i, a)))
    assert sorted((r.i, r.attempt) for r in design.fresh_keyed(frame([2, 1, 2, 1, 3]), "i", keys, none).collect()) == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
    with pytest.raises(ValueError, match="without i"):
        design.fresh_keyed(frame([1, None]), "i", keys, none)


@pytest.mark.parametrize(("items", "before"), [(["O_x", "O_z", "C_x", "C_z"], [("O_x", "C_x"), ("O_z", "C_z")]), (list("abcde"), [("e", "a"), ("c", "b")]), (list("abcd"), []), (["a"], [])])
def test_orders_by_number_are_those_of_the_list(spark, items, before):
    want = design.legal_orders(items, before)
    got = [r.o for r in spark.range(-1, len(want) + 1).select("id", design.nth_order(F.col("id"), items, before).alias("o")).orderBy("id").collect()]
    assert got == [None, *map(list, want), None]


def test_chains_are_as_if_drawn_one_by_one(spark):
    values, rows = list("abcdefg"), [(d, h) for d in (1, 2) for h in range(12)]
    got = {(r.d, r.h): r for r in design.version_chains(spark.createDataFrame(rows, "d int, h int"), "d", "h", values, "s", spark.createDataFrame([("1|a,b|c,d",)], "signature string")).collect()}
    seen = {"1|a,b|c,d"}
    for d, h in rows:
        for a in range(1_000):
            own = sorted(values, key=lambda v: hashlib.md5(f"s:{d}:{h}:{a}:{v}".encode()).hexdigest())[: 2 * d + 2]  # noqa: B023
            x, z = own[: d + 1], own[d + 1 :]
            keys = {f"{d}|{','.join(x)}|{','.join(z)}", f"{d}|{','.join(z)}|{','.join(x)}"}
            if not keys & seen:
                break
        seen |= keys
        r = got[d, h]
        assert (r.attempt, r.x, r.z, r.orientation) == (a, x, z, h % 2) and r.block_order == (["x", "z"] if h // 2 % 2 == 0 else ["z", "x"])
    assert len(got) == 24 and set(Counter((r.d, r.orientation, tuple(r.block_order)) for r in got.values()).values()) == {3}


def test_chain_members(spark):
    values = list("abcdefgh")
    chains = design.version_chains(spark.createDataFrame([(2, 0), (1, 0)], "d int, h int"), "d", "h", values, "s")
    rows = design.chain_members(chains, "d", values, "t").collect()
    whole = {r.history: r for r in chains.collect()}
    assert len(rows) == sum(2 * (r.d + 1) * 4 for r in whole.values())
    for r in rows:
        c = whole[r.history]
        versions = {"x": list(c.x), "z": list(c.z)}
        assert r.source == versions[r.variable][r.version] and r.replacement not in c.x + c.z and r.age == c.d - r.version
        if r.direction:
            versions[r.variable][r.version] = r.replacement
        assert r.answer == versions[r["query"]][-1]


def test_planted_breaks_of_a_lineage_graph(spark):
    stages = spark.createDataFrame([(s, f"sha-{s}") for s in "abcdefghij"], "stage string, sha256 string")
    good = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]
    frame = lambda links: spark.createDataFrame([(s, p, sha) for s, p, sha in links], "stage string, parent string, sha256 string")
    right = [(s, p, f"sha-{p}") for s, p in good]
    gates = spark.createDataFrame([("d", True, True)], "stage string, said boolean, found boolean")
    found = lambda links, g=None: {tuple(r) for r in lineage.lineage_breaks(stages, frame(links), g).collect()}
    assert found(right, gates) == set() and found([]) == set()
    lineage.verify_lineage(stages, frame(right), gates)
    assert found([*right[1:], ("b", "a", "old")]) == {("b", "stale_parent", "a"), ("d", "tainted", "b"), ("e", "tainted", "d")}
    assert found([*right, ("c", "zz", "x")]) == {("c", "missing_parent", "zz"), ("d", "tainted", "c"), ("e", "tainted", "d")}
    ring = [("f", "g", "sha-g"), ("g", "h", "sha-h"), ("h", "f", "sha-f"), ("i", "f", "sha-f"), ("f", "e", "sha-e"), ("j", "j", "sha-j"), ("i", "j", "sha-j")]
    got = found([*right, *ring])
    assert {x for x in got if x[1] == "cycle"} == {(s, "cycle", None) for s in "fghj"} and ("i", "tainted", "f") in got and not {x for x in got if x[0] in "abcde"}
    for said, again in ((True, False), (False, True), (True, None), (False, False)):
        got = found(right, spark.createDataFrame([("c", said, again)], "stage string, said boolean, found boolean"))
        assert got == {("c", "failed_gate", None), ("d", "tainted", "c"), ("e", "tainted", "d")}
    with pytest.raises(ValidationError, match="lineage"):
        lineage.verify_lineage(stages, frame([*right, ("c", "zz", "x")]))


def test_spans_of_token_pairs(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(3) for _ in range(rng.randrange(8))], [rng.randrange(3) for _ in range(rng.randrange(8))]) for _ in range(300)] + [([1, 2], [1, 2]), ([], []), ([1, 1, 1], [1, 1]), ([], [4])]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", tokens.pair_spans(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        k = 0
        while k < min(len(r.a), len(r.b)) and r.a[k] == r.b[k]:
            k += 1
        e = 0
        while e < min(len(r.a), len(r.b)) - k and r.a[-1 - e] == r.b[-1 - e]:
            e += 1
        assert tuple(r.s) == (k, len(r.a) - e, len(r.b) - e, len(r.b) - len(r.a))
    pairs = spark.createDataFrame([(1, [7, 8, 9], [7, 5, 5, 9], 1, 1)], "k int, a array<int>, b array<int>, lo int, hi int")
    assert [tuple(r) for r in tokens.pair_audit(pairs, ["k"], "a", "b", ("lo", "hi")).collect()] == [(1, 1, 2, 3, 1, [8], [5, 5])]
    for bad, why in ((pairs.withColumn("b", F.col("a")), "unchanged_pair"), (pairs.withColumn("lo", F.lit(2)), "edit_outside_span")):
        with pytest.raises(ValidationError, match=why):
            tokens.pair_audit(bad, ["k"], "a", "b", ("lo", "hi"))
    assert [tuple(r) for r in tokens.token_counts(pairs.withColumn("f", F.lit("x")), "f", "b").collect()] == [("x", 4, 4, 4.0)]


def test_chains_without_fresh_are_first_attempts(spark):
    """Few values for many histories: first attempts repeat, and stay as they are where that is asked."""
    rows = spark.range(60).selectExpr("1 as depth", "id as number")
    first = design.version_chains(rows, "depth", "number", ["a", "b", "c", "d", "e"], "s", fresh=False).collect()
    again = {r.number: r for r in design.version_chains(rows, "depth", "number", ["a", "b", "c", "d", "e"], "s").collect()}
    assert len(first) == 60 and {r.attempt for r in first} == {0} and len({frozenset([tuple(r.x), tuple(r.z)]) for r in first}) < 60
    assert len({frozenset([tuple(r.x), tuple(r.z)]) for r in again.values()}) == 60
    assert all(again[r.number] == r for r in first if again[r.number].attempt == 0)


def test_means_of_twenty_are_no_more_than_twenty(spark, tmp_path):
    import datetime

    from twinfold.plans import effects

    values = [19.69, 20.85, 19.59, 19.87]
    assert reduce(float.__add__, values) / 4 > 20  # by rounding alone
    t = datetime.datetime(2024, 1, 2)
    rows = [(i, t, 1, "click", v) for i, v in enumerate(values)] + [(9, t, 2, "click", 20.01)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in effects.tracked_histories_semi(spark, str(tmp_path)).collect()] == [(2, 1)]


def test_means_about_twenty_are_as_in_the_sql(spark, tmp_path):
    """Where the SQL has one answer: cells without values, single values close to 20, two values, NaN and values beyond decimals."""
    import datetime

    from twinfold.plans import base, effects

    duckdb = pytest.importorskip("duckdb")
    assert (-100.3 + 140.3) / 2 > 20  # in either order
    cells = [(1, "click", [30.0]), (1, "view", [None]), (2, "view", [None]), (3, "click", [20.0000000001]), (4, "click", [19.9999999999]), (5, "click", [20.0]), (6, "click", [-100.3, 140.3]), (7, "click", [float("nan"), 1.0, 2.0]), (8, "click", [1e30, 1.0, 2.0])]
    cells += [(9, "click", [20.0, 20.0, 20.0000000002]), (9, "view", [None, 21.0]), (10, "click", [30.0]), (10, "view", [19.0, None, 20.5])]
    rows = [(i, datetime.datetime(2024, 1, 2), h, f, v) for i, (h, f, v) in enumerate((h, f, v) for h, f, values in cells for v in values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(base.ORACLES["tracked_histories_semi"]).fetchall())
    assert sorted(tuple(r) for r in effects.tracked_histories_semi(spark, str(tmp_path)).collect()) == want == [(1, 2), (3, 1), (6, 1), (7, 1), (8, 1), (9, 2)]
