"""Operators against hand-computed constants, planted effects and mutations."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import digests, scores, stats, text
from twinfold.operators import checks, contrasts, design, gates, grouping, joins, lineage, ordered, pairs, predict, probes, protocols, resample
from twinfold.sources import records
from twinfold.streaming import append


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_ranks_tie_rules(spark):
    row = spark.range(1).select(
        scores.strict_rank(arr(1, 2, 2), F.lit(1)).alias("strict"), scores.lenient_rank(arr(1, 2, 2), F.lit(1)).alias("lenient"), scores.argmax_first(arr(1, 2, 2)).alias("first"),
        scores.strongest_other(arr(1, 2, 2), F.lit(0)).alias("other"), scores.competitor_margin(arr(5, 2, 3), F.lit(0)).alias("margin"), scores.strict_first(arr(3, 2, 1), F.lit(0)).alias("top"),
    ).first()
    assert (row.strict, row.lenient, row.first, row.other, row.margin, row.top) == (2, 1, 1, 1, 2.0, True)


def test_logsumexp_edges(spark):
    inf = float("inf")
    row = spark.range(1).select(scores.logsumexp(arr(0, 0)).alias("a"), scores.logsumexp(arr(-inf, 1)).alias("b"), scores.logsumexp(arr(-inf)).alias("c"), scores.logsumexp(arr(float("nan"), 1)).alias("d"), scores.logsumexp(arr(inf)).alias("e")).first()
    assert row.a == pytest.approx(math.log(2)) and row.b == 1.0 and row.c is None and row.d is None and row.e is None


def test_js_of_equal_and_disjoint(spark):
    row = spark.range(1).select(scores.js_divergence(arr(0.5, 0.5), arr(0.5, 0.5)).alias("same"), scores.js_divergence(arr(1, 0), arr(0, 1)).alias("apart")).first()
    assert row.same == 0 and math.log(2) - 1e-6 < row.apart < math.log(2)


def test_softmax_and_mass(spark):
    row = spark.range(1).select(scores.softmax(arr(1000, 1000)).alias("p"), scores.mass(F.create_map(F.lit("a"), F.lit(math.log(0.25)), F.lit("b"), F.lit(math.log(0.5)))).alias("m")).first()
    assert row.p == [0.5, 0.5] and row.m == pytest.approx(0.75)


def test_label_parses(spark):
    df = spark.createDataFrame([(" yes ",), ("say yes now",), ("yes or no",), ("yesterday",), ("yes\n",), ("\tyes",), ("\u00a0yes\u2003\r\n",), ("yes.",)], ["t"])
    got = [tuple(r) for r in df.select(text.strict_label(F.col("t"), ["yes", "no"]), text.relaxed_label(F.col("t"), ["yes", "no"])).collect()]
    assert got == [("yes", "yes"), (None, "yes"), (None, None), (None, None), ("yes", "yes"), ("yes", "yes"), ("yes", "yes"), (None, "yes")]
    row = spark.createDataFrame([("is it a.b (c)? axb", ["a.b", "x"])], ["t", "labels"]).select(
        text.relaxed_label(F.col("t"), F.col("labels")).alias("dot"), text.relaxed_label(F.col("t"), ["(c)?", "no"]).alias("marks"), text.label_class(F.lit("yes\n"), ["yes", "no"], F.lit("yes")).alias("ended"),
        text.label_class(F.lit("yes"), ["yes", "no"], F.lit("yes"), F.lit(False)).alias("cut"), text.label_class(F.lit("no"), ["yes", "no"], F.lit("yes"), F.lit(True)).alias("wrong"),
        text.after_marker(F.lit("think</t>\nyes<end>\n"), "</t>", F.lit(False), "<end>").alias("after"), text.first_case({"a": F.lit(None).cast("boolean"), "b": F.lit(True), "c": F.lit(True)}, "d").alias("first"),
        text.tags({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)}).alias("tags"), text.common_prefix(F.repeat(F.lit("ab"), 1_200_000), F.repeat(F.lit("ab"), 1_200_000)).alias("long"),
        text.name_value_distance(F.array(*map(F.lit, ["Previously", ",", " Al", "ma", "’s", " badge", " was", " am", "ber", "."])), F.lit("Alma"), F.lit("amber")).alias("distance"),
        text.utc_stamp(F.lit("2026-01-31 12:00:00").cast("timestamp")).alias("stamp"),
    ).first()
    assert tuple(row) == ("a.b", "(c)?", "correct", "invalid", "wrong", "yes", "b", "a+c", 2_400_000, 3, "2026-01-31T12:00:00Z")


def test_whole_texts_of_every_row_are_parsed(spark, tmp_path):
    import re

    import __spark_entry__ as entry

    texts = ["The answer\nis Élan, and it ends well beyond forty characters!?\n", "thé\nand", "éand the", "the\nand", "a\nthe\nb", "the\u00e9 theé", "and_ the", "日本the", "x.\u0085", " .,\n ", "", None, "AND\x0b;"]
    spark.createDataFrame([(i, 0, " user ", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    answers = {r.conv_id: (r.answer, r.starts_with) for r in entry.queries()["complete_answer_whole_text"](spark, str(tmp_path)).collect()}
    labels = {r.conv_id: r.relaxed for r in entry.queries()["strict_relaxed_whole_text"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        low = None if t is None else t.lower()
        hits = [w for w in ("the", "and") if re.search(rf"(?<!\w){w}(?!\w)", t or "")]
        assert answers[i] == (None if t is None else low.strip().strip("\"'`.,;:!? "), next((c for c in ("The", "And") if (low or "").startswith(c.lower())), None)), t
        assert labels[i] == (hits[0] if len(hits) == 1 else None), t


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.complete_answer(F.lit(' "Paris." ')).alias("answer"), text.after_marker(F.lit("<t>a</t> b"), "</t>", F.lit(False)).alias("after"), text.after_marker(F.lit("no mark"), "</t>", F.lit(False)).alias("open"),
        text.replace_first(F.lit("a-b-b"), F.lit("b"), F.lit("xx")).alias("swap"), text.changed_middle(F.lit("abcd"), F.lit("abXYd")).alias("middle"), text.temporal_gap(F.array(F.lit("o"), F.lit("x"), F.lit("c")), F.lit("c"), F.lit("o")).alias("gap"),
        text.span_distance(F.lit(3), F.lit(5), F.lit(7)).alias("right"), text.span_distance(F.lit(3), F.lit(5), F.lit(4)).alias("inside"), text.prefix_candidate(F.lit("PARIS is"), ["rome", "paris"]).alias("prefix"),
    ).first()
    assert tuple(row) == ("paris", "b", None, "a-xx-b", "XY", 1, 3, 0, "paris")


def test_trimmed_means_differ(spark):
    df = spark.createDataFrame([(float(x),) for x in range(15)], ["x"])
    row = df.agg(stats.trimmed_mean(F.col("x")).alias("a"), stats.trimmed_mean_asymmetric(F.col("x")).alias("b"), stats.upper_median(F.col("x")).alias("m"), stats.p95_element(F.col("x")).alias("p")).first()
    assert row.a == np.mean(range(1, 14)) and row.b == np.mean(range(1, 14)) and row.m == 7.0 and row.p == 13.0


def planted(spark):
    """All log probabilities -3; member 0 of `superseded` has -2 on the wrong action, so its shift is 1 and others' 0."""
    rows = []
    for h in range(4):
        for family in ("superseded", "mention"):
            for m in (0, 1):
                rows.append((f"h{h}", family, m, {"go": -3.0, "stop": -2.0 if (family, m) == ("superseded", 0) else -3.0}))
    return spark.createDataFrame(rows, "history string, family string, member int, lp map<string,double>")


def test_planted_shift_is_recovered(spark):
    p = pairs.paired(planted(spark), ["history", "family"], "member", ["lp"])
    got = {(r.history, r.family): r.d for r in p.select("history", "family", pairs.decision_shift(F.col("lp_0"), F.col("lp_1"), F.lit("stop"), F.lit("go")).alias("d")).collect()}
    assert all(d == (1.0 if f == "superseded" else 0.0) for (_, f), d in got.items()) and len(got) == 8


def test_identity_transfer_components(spark):
    b, e = F.create_map(F.lit("s"), F.lit(1.0), F.lit("r"), F.lit(0.0)), F.create_map(F.lit("s"), F.lit(0.5), F.lit("r"), F.lit(6.0))
    found = pairs.identity_transfer(b, e, F.lit("s"), F.lit("r"))
    row = spark.range(1).select(*(c.alias(n) for n, c in found.items())).first()
    assert row.effect == 6.5 == row.replacement_change - row.source_change


def test_symmetric_relevance(spark):
    rows = [("h", e, q, o, (6.0 if e == q else 0.0) + o) for e in "xz" for q in "xz" for o in (4.0, -4.0)]
    df = spark.createDataFrame(rows, ["history", "edited", "query", "slot", "v"])
    assert contrasts.symmetric_relevance(df, ["history"], "edited", "query", "v", ("x", "z")).first().relevance == 6.0


def test_version_contrasts_and_window(spark):
    df = spark.createDataFrame([("h", i, float(v)) for i, v in enumerate((1, 2, 6))], ["h", "i", "v"])
    got = [tuple(r)[3:] for r in contrasts.version_contrasts(df, ["h"], "i", "v").orderBy("i").collect()]
    assert got == [(None, None), (1.0, None), (4.0, 1.0)]
    flat = spark.createDataFrame([("a", k, 1.0) for k in range(5)] + [("b", 0, 99.0)], ["h", "layer", "v"])
    assert tuple(contrasts.best_window(flat, "h", "layer", "v", 3).first()) == (0, 1.0)  # a tie goes to the first; b lacks layers


@pytest.mark.parametrize("bad", ["duplicate", "missing", "extra", "metadata"])
def test_one_to_one_fails_closed(spark, bad):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], ["example_id", "k"])
    made = {"duplicate": [("a", 1), ("a", 1), ("b", 2)], "missing": [("a", 1)], "extra": [("a", 1), ("b", 2), ("c", 3)], "metadata": [("a", 1), ("b", 9)]}[bad]
    with pytest.raises(checks.ValidationError):
        joins.one_to_one(rows, spark.createDataFrame(made, ["example_id", "k"]).withColumn("s", F.lit(0.0)))


def test_one_to_one_joins(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "example_id string, k int")
    assert joins.one_to_one(rows, rows.withColumn("s", F.lit(1.0))).count() == 2


def test_score_map_checks(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": float("nan")},), ({"a": 1.0},), ({"a": 1.0, "b": 2.0},)], "m map<string,double>")
    assert checks.finite_map(df, "m", F.array(F.lit("b"), F.lit("a"))).violations.count() == 2
    with pytest.raises(checks.ValidationError):
        checks.forbidden_columns(df, ["m"])


def test_completeness(spark):
    df = spark.createDataFrame([("h", 0), ("h", 1), ("k", 0)], ["h", "c"])
    assert [tuple(r) for r in checks.missing_cells(df, "h", ["c"]).collect()] == [("k", 1)]
    with pytest.raises(checks.ValidationError):
        checks.enforce(checks.complete(df, "h", ["c"]))


def test_gates(spark):
    cells = spark.createDataFrame([(1, 0.99, True), (2, 0.7, False), (4, 0.8, True)], ["depth", "acc", "passes"])
    assert [r.open for r in gates.prefix_gate(cells.withColumn("g", F.lit(0)), ["g"], "depth").orderBy("depth").collect()] == [True, False, False]
    assert gates.pick_difficulty(cells, "depth", "acc").first().depth == 4
    assert gates.pick_difficulty(cells, "depth", "acc", 0.1, 0.2, 0.71).first().depth == 2
    plan = spark.createDataFrame([("a", "done", [], 0), ("b", "todo", ["x"], 1), ("c", "todo", ["a"], 2)], "id string, status string, deps array<string>, ord int")
    assert gates.next_step(plan).first().id == "c"
    gated = gates.cell_gate(cells, {"high": F.col("acc") > 0.75, "deep": F.col("depth") > 1})
    assert [r.failed for r in gated.orderBy("depth").collect()] == [["deep"], ["high"], []]
    assert spark.range(1).select(gates.least_count(F.lit(100), 0.95).alias("x")).first().x == 95


def test_exact_bootstrap_is_numpys(spark):
    x = np.random.default_rng(1).normal(size=37)
    rng = np.random.default_rng(81004)
    want = np.quantile(x[rng.integers(37, size=(2000, 37))].mean(axis=1), [(1 - 0.975) / 2, (1 + 0.975) / 2])
    got = resample.exact_interval(x, level=0.975)
    assert (got["low"], got["high"]) == tuple(want)
    old, resample.CHUNK = resample.CHUNK, 37 * 7
    try:
        assert resample.exact_interval(x, level=0.975) == pytest.approx(got, rel=1e-12)  # chunks continue one stream
    finally:
        resample.CHUNK = old
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], ["g", "i", "v"]).repartition(4)
    row = resample.by_group(df, ["g"], ["i"], "v", lambda v: resample.exact_interval(v, level=0.975), "g string, n long, mean double, low double, high double").first()
    assert (row.low, row.high) == pytest.approx(tuple(want), rel=1e-12)


def test_exact_edges():
    assert resample.exact_summary(np.array([]))["mean"] is None
    for bad in ([], [float("nan")]):
        with pytest.raises(ValueError):
            resample.exact_interval(bad)
    assert resample.exact_permutation(np.ones(8), 500)["p"] < 0.05
    assert resample.exact_cluster(np.arange(6.0), np.array([0, 0, 1, 1, 2, 2]), 50)["n"] == 3
    assert resample.exact_two_sample([1, 1], [0, 0], 20)["low"] == 1.0


def test_shared_stream_order(spark):
    df = spark.createDataFrame([(g, i, float(i + ord(g))) for g in "ba" for i in range(9)], ["g", "i", "v"])
    rng = np.random.default_rng(0)
    want = {g: tuple(np.quantile(rng.choice(np.arange(9.0) + ord(g), (200, 9)).mean(axis=1), [0.025, 0.975])) for g in "ab"}
    assert {r.g: (r.low, r.high) for r in resample.shared_stream(df, "g", ["i"], "v", 200).collect()} == want


def test_grid_and_members(spark):
    g = design.grid(spark, {"task": ["access", "routing"], "level": [1, 2, 3]}, 2)
    assert g.count() == 12 and sorted(r.ord for r in g.collect()) == list(range(12))
    assert design.with_members(g, {"superseded": 2, "current_only": 1}).count() == 36
    assert g.filter("ord = 4").first().level == 2


def test_render_spans(spark):
    prompt, spans = design.render([F.lit("a’b"), F.lit("cd")])
    row = spark.range(1).select(prompt.alias("p"), spans[1].alias("s")).first()
    assert row.p[row.s[0] : row.s[1]] == "cd"
    inside = spark.range(1).select(design.differs_only_inside(F.lit("say red now"), F.lit("say blue now"), F.array(F.lit(4), F.lit(7))).alias("ok"), design.differs_only_inside(F.lit("say red now"), F.lit("say blue then"), F.array(F.lit(4), F.lit(7))).alias("no")).first()
    assert inside.ok and not inside.no
    assert len(design.legal_orders("abcd", [("a", "b"), ("c", "d")])) == 6


def test_folds_and_fit():
    folds = predict.greedy_folds({"a": 5, "b": 3, "c": 2, "d": 2}, 2)
    assert sorted(sum(s for g, s in {"a": 5, "b": 3, "c": 2, "d": 2}.items() if folds[g] == f) for f in (0, 1)) in ([5, 7], [6, 6])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    w = predict.fit_logistic(x, y)
    grad = x.T @ (1 / (1 + np.exp(-(x @ w[:2] + w[2]))) - y) + w[:2]
    assert np.abs(grad).max() < 1e-6 and w[0] > 1


def test_cross_validation_equals_separate_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 2)) * [1, 50] + [0, 9]
    y = (rng.random(240) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(v), i % 3) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], ["id", "a", "b", "y", "fold"])
    got = {r.id: r.p for r in predict.cross_validated(df, ["a", "b"], "y", "fold", ["id"], 3).collect()}
    for f in range(3):
        train = np.arange(240) % 3 != f
        m, s = x[train].mean(axis=0), x[train].std(axis=0)
        w = predict.fit_logistic((x[train] - m) / s, y[train].astype(float))
        for i in np.flatnonzero(~train):
            assert got[i] == pytest.approx(1 / (1 + np.exp(-(((x[i] - m) / s) @ w[:2] + w[2]))), abs=1e-7)
    one_class = predict.cross_validated(df.withColumn("y", F.lit(1)), ["a"], "y", "fold", ["id"], 3)
    assert {r.p for r in one_class.collect()} == {None}


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], ["y", "p"])
    row = predict.metrics(df, "y", "p").first()
    assert row.auroc == pytest.approx((0.5 + 1 + 0 + 1) / 4) and row.n == 4
    assert predict.average_precision(df, "y", "p").first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_sums_before(spark):
    df = spark.createDataFrame([(i, 1) for i in range(50)], ["i", "one"]).repartition(3)
    got = ordered.sums_before(df, [], F.floor(F.col("i") / 7), [F.col("i")], {"before": F.col("one")})
    assert all(r.before == r.i for r in got.collect())


def test_grouping_helpers(spark):
    df = spark.createDataFrame([("g", "x", 3), ("g", "y", 1), ("g", "y", 5), ("g", "x", 4), ("g", "z", 0)], ["g", "item", "ord"])
    assert [(r["item"], r.n) for r in grouping.top_k(df, ["g"], "item", "ord", 2).orderBy("place").collect()] == [("y", 2), ("x", 2)]
    numbers = spark.createDataFrame([("a.b", 0.1234), ("c", 12.34)], ["path", "value"])
    literals = spark.createDataFrame([("12.3",), ("0.12",), ("7",)], ["text"])
    assert {r.text: r.paths for r in grouping.trace_numbers(numbers, literals).collect()} == {"12.3": ["a.b", "c"], "0.12": ["a.b"], "7": []}


def test_digest_is_pythons(spark):
    raw = '{"b": 1e-05, "a": "é"}'
    got = spark.createDataFrame([(raw,)], ["j"]).select(digests.canonical_json_digest("j").alias("d")).first().d
    assert got == digests.canonical(json.loads(raw))
    row = spark.range(1).select(digests.native_hash([F.lit(None).cast("string"), F.lit("")]).alias("a"), digests.native_hash([F.lit(""), F.lit(None).cast("string")]).alias("b")).first()
    assert row.a != row.b


def test_jsonl_round_trip_and_recovery(spark, tmp_path):
    out = str(tmp_path / "x.jsonl")
    df = spark.createDataFrame([("a", {"k": 1.5}), ("b", None)], "id string, m map<string,double>")
    records.write_jsonl(df, out)
    assert sorted(r.id for r in records.read_jsonl(spark, out, "id string, m map<string,double>").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="exist"):
        records.write_jsonl(df, out)
    cut = tmp_path / "cut.jsonl"
    cut.write_text('{"id":"a"}\n\n{"id":"b"}\n{"id":"c')
    good, tail = records.recover_jsonl(spark, str(cut), "id string")
    assert sorted(r.id for r in good.collect()) == ["a", "b"] and [r.value for r in tail.collect()] == ['{"id":"c']
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(cut), "id string").collect()


def test_bundle_tensor_and_tables(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"id": "a"}, {"id": "b"}]}))
    assert records.read_bundle(spark, str(tmp_path / "b.json"), "id string").count() == 2
    np.savez(tmp_path / "t.npz", h=np.ones((3, 4), np.float16))
    assert records.read_tensors(spark, str(tmp_path / "t.npz"), "h").count() == 3
    assert records.discover(spark, str(tmp_path), ["t."], ["b."]).count() == 1
    table = records.to_markdown(spark.createDataFrame([("a", 1.23456)], ["n", "v"]))
    assert table.splitlines() == ["| n | v |", "|---|---|", "| a | 1.235 |"]


def test_append_once(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    data = spark.createDataFrame([("a",), ("b",)], ["example_id"])
    (tmp_path / "in" / "1.json").write_text('{"example_id":"a","s":1}\n{"example_id":"a","s":1}\n{"example_id":"zz","s":1}\n')
    append.append_once(spark, inbox, "example_id string, s int", data, out, mark).awaitTermination(60)
    assert not append.is_complete(spark.read.parquet(out), data)
    (tmp_path / "in" / "2.json").write_text('{"example_id":"b","s":2}\n{"example_id":"a","s":1}\n')
    append.append_once(spark, inbox, "example_id string, s int", data, out, mark).awaitTermination(60)
    assert sorted(r.example_id for r in spark.read.parquet(out).collect()) == ["a", "b"] and append.is_complete(spark.read.parquet(out), data)


def test_fake_scorer_is_stable(spark):
    rows = spark.createDataFrame([("a",), ("b",)], ["example_id"])
    scored = append.score_with(rows, append.digest_scorer("example_id", ["x", "y"]), "example_id string, action_logp map<string,double>")
    got = {r.example_id: r.action_logp for r in scored.collect()}
    assert all(math.isclose(sum(map(math.exp, m.values())), 1, rel_tol=0.02) for m in got.values()) and got == {r.example_id: r.action_logp for r in scored.collect()}


def test_seal_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], ["id", "v"])
    first = lineage.seal(df, ["id"]).first()
    assert first == lineage.seal(df.repartition(7).orderBy("v"), ["id"]).first() and first.unique
    assert lineage.seal(df.withColumn("v", F.when(F.col("id") == 3, "x").otherwise(F.col("v"))), ["id"]).first().seal != first.seal
    kept = lineage.with_checksum(df)
    assert lineage.bad_checksums(kept).count() == 0
    assert lineage.bad_checksums(kept.withColumn("v", F.when(F.col("id") == 3, "x").otherwise(F.col("v")))).count() == 1


def test_stages_must_chain(spark, tmp_path):
    good = spark.createDataFrame([("dev", 0, "a", "b"), ("gate", 1, "b", "c")], "name string, ord int, input_sha256 string, output_sha256 string")
    lineage.verify_stages(good)
    with pytest.raises(checks.ValidationError, match="gate"):
        lineage.verify_stages(good.withColumn("output_sha256", F.lit("z")))
    (tmp_path / "x").write_bytes(b"abc")
    assert lineage.file_digests(spark, str(tmp_path / "x")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_order_contrasts_by_slot(spark):
    df = spark.createDataFrame([("h", i, j, 4.0 if i == j else -4.0) for i in (0, 1) for j in (0, 1)], ["k", "h", "c", "v"])
    row = protocols.order_contrasts(df, ["k"], "h", "c", "v").first()
    assert (row.aligned, row.reversed, row.interaction) == (4.0, -4.0, 8.0)


def test_version_selectivity_needs_all_cells(spark):
    names = ["old_x", "new_x", "old_z", "new_z"]
    rows = [("a", b, q, float(b == q)) for b in names for q in names] + [("b", b, q, 1.0) for b in names[:2] for q in names]
    got = {r.h: r for r in protocols.version_selectivity(spark.createDataFrame(rows, ["h", "b", "q", "v"]), "h", "b", "q", "v").collect()}
    assert got["a"].selectivity == 1.0 and got["b"].selectivity is None and got["b"].selectivity_x == 0.0


def test_probe_finds_a_planted_direction(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 4 * (i % 2)], i % 2, ("train", "train", "validation", "test")[(i // 2) % 4]) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, split string")
    found = [probes.probe_layer(df, "v", "y", "split", (0.01, 1.0), seed, "id") for seed in range(3)]
    assert all(f["accuracy"] > 0.95 and f["n_train"] == 80 for f in found)
    assert min(f["shuffled"] for f in found) < 0.9  # a permuted label points either way along the one direction there is


def test_score_helpers(spark):
    row = spark.range(1).select(
        scores.semantic_log_mass(F.create_map(F.lit("a"), F.array(*(F.struct(F.lit(0.0).alias("log_probability")) for _ in range(2))))).alias("m"), scores.normalized(F.lit("stale"), {"stale": "historical"}, "none").alias("a"), scores.normalized(F.lit(None).cast("string"), {"stale": "historical"}, "none").alias("b"),
        scores.inverse_map(F.create_map(F.lit("s"), F.lit("go"), F.lit("r"), F.lit("go")), F.lit("go")).alias("i"), scores.set_key(F.create_map(F.lit("s"), F.lit("x")), F.lit("s"), F.lit("y")).alias("k"), scores.normalized_depth(F.lit(3), F.lit(4)).alias("d"),
    ).first()
    assert row.m["a"] == pytest.approx(math.log(2)) and (row.a, row.b, row.i, row.k, row.d) == ("historical", "none", ["r", "s"], {"s": "y"}, 1.0)


def test_name_value_distance_equals_its_definition(spark):
    """Against the rule itself: repeated, overlapping, empty and missing words over tokens that split them."""
    rng = random.Random(3)
    rows = [(i, [rng.choice(["a", "b", "ab", "", "é", None, "ba"]) for _ in range(rng.randrange(8))], rng.choice(["a", "ab", "é", "", "bab", None]), rng.choice(["b", "aa", "ba", "", "é", None])) for i in range(400)]

    def want(pieces, name, value):
        joined = lambda a, b: "".join(p for p in pieces[a:b] if p is not None)
        end = lambda w: next((k for k in range(len(pieces) + 1) if w is not None and w in joined(0, k)), None)
        if end(name) is None or not end(value):
            return None
        return max(k for k in range(end(value)) if value in joined(k, end(value))) - end(name)

    df = spark.createDataFrame(rows, "i int, p array<string>, n string, v string")
    got = {r.i: r.d for r in df.select("i", text.name_value_distance(F.col("p"), F.col("n"), F.col("v")).alias("d")).collect()}
    assert got == {i: want(p, n, v) for i, p, n, v in rows}


def test_long_token_arrays_cost_one_pass(spark):
    """2,000 tokens a row: joining every prefix took time of their number's square."""
    df = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: k.cast("string")).alias("p"))
    began = time.time()
    assert {r[0] for r in df.select(text.name_value_distance(F.col("p"), F.lit("5051"), F.lit("19981999"))).collect()} == {1997 - 51}
    assert time.time() - began < 30


def test_exploded_rows_are_not_sent_to_all(spark):
    """Spark takes rows for the size that they have before an explode: none of these joins may be broadcast for it."""
    from twinfold.operators import joins, resample

    rows = spark.createDataFrame([("g", i, float(i)) for i in range(50)], "g string, k long, v double")
    lists = spark.createDataFrame([(1, [1]), (2, [1, 2]), (3, [2])], "k int, t array<int>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(resample, "SENT", 0)
        frames = [resample.bootstrap_means(rows, ["g"], ["k"], ["v"], 5, "s"), joins.proper_prefixes(lists, "k", "t"), records.complete_units(rows, "k", F.col("v"))]
    for found in frames:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in frames[1].collect()] == [(1, 2)]
