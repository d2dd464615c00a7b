"""Designs, gates, token audits, folds, ranks and records against plain computations and mutations."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions.digests import canonical
from twinfold.operators import checks, contrasts, design, gates, joins, lineage, ordered, predict, probes, resample, tokens
from twinfold.operators.pinning import shared_checkpoints
from twinfold.sources import records
from twinfold.streaming import append


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "text"])
def test_ranks_by_buckets_equal_sorting(spark, shape):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=700), "heavy": np.exp(8 * rng.normal(size=700)) * rng.choice([-1, 1], 700), "ties": np.repeat([3.0, 3.0, 7.0, -1.0], 150), "text": [f"id-{i:05d}" for i in rng.permutation(600)]}[shape]
    df = spark.createDataFrame([(i % 2, v.item() if hasattr(v, "item") else v) for i, v in enumerate(x)], ["g", "v"]).repartition(5)
    n = {(r.g, r.i): r.v for r in resample.numbered(df, ["g"], ["v"]).collect()}
    for g in (0, 1):
        own = sorted(v for i, v in enumerate(x) if i % 2 == g)
        assert [n[g, i] for i in range(len(own))] == own
    if shape != "text":
        for r in ordered.order_statistics(df, ["g"], "v").collect():
            own, k = sorted(v for i, v in enumerate(x) if i % 2 == r.g), len(x) // 2
            cut = int(0.1 * k)
            assert r.trimmed == pytest.approx(np.mean(own[cut : k - cut])) and r.trimmed_asymmetric == pytest.approx(np.mean(own[cut : math.ceil(0.9 * k)]))
            assert r.upper_median == own[k // 2] and r.p95 == own[int(0.95 * (k - 1))]


def test_exact_streams_are_numpys():
    x, groups = np.random.default_rng(2).normal(size=24), np.repeat(list("cabd"), 6)
    rng = np.random.default_rng(7)
    means = [np.concatenate([x[groups == g] for g in rng.choice(np.unique(groups), 4)]).mean() for _ in range(300)]
    got = resample.exact_cluster(x, groups, 300, 7)
    assert (got["low"], got["high"]) == tuple(np.quantile(means, [0.025, 0.975]))
    rng = np.random.default_rng(9)
    boot = rng.choice(x, (400, 24)).mean(axis=1)
    flips = (x * rng.choice([-1, 1], (400, 24))).mean(axis=1)
    got = resample.exact_permutation(x, 400, 9)
    assert (got["low"], got["high"]) == tuple(np.quantile(boot, [0.025, 0.975])) and got["p"] == ((np.abs(flips) >= abs(x.mean())).sum() + 1) / 401
    rng = np.random.default_rng(5)
    a, b = x[rng.integers(24, size=(200, 24))].mean(axis=1), x[:9][rng.integers(9, size=(200, 9))].mean(axis=1)
    got = resample.exact_two_sample(x, x[:9], 200, 5)
    assert (got["low"], got["high"]) == tuple(np.quantile(a - b, [0.025, 0.975]))
    assert resample.derived_seed(100, 3, 2) == 100 + 3 * 31 + 2


def test_fresh_signatures_are_drawn_row_by_row(spark):
    def draw(i, a):
        return resample.md5_number(F.lit("s"), i, a) % 60

    got = {r.i: r.signature for r in design.fresh_signatures(spark.range(40).select(F.col("id").alias("i")), "i", draw, spark.createDataFrame([(3,), (5,)], "signature long")).collect()}
    taken, want = {3, 5}, {}
    for i in range(40):
        a = 0
        while (s := int(hashlib.md5(f"s:{i}:{a}".encode()).hexdigest()[:8], 16) % 60) in taken:
            a += 1
        taken.add(s)
        want[i] = s
    assert got == want
    with pytest.raises(ValueError, match="no fresh"):
        design.fresh_signatures(spark.range(3).select(F.col("id").alias("i")), "i", lambda i, a: F.lit(1), spark.createDataFrame([], "signature int"), 4)


def test_partitions(spark):
    ids = [f"h{i}" for i in range(30)]
    want = sorted(ids)
    np.random.default_rng(20260929).shuffle(want)
    assert design.exact_partition(reversed(ids), 24, 20260929) == (want[:24], want[24:])
    with pytest.raises(ValueError):
        design.exact_partition(ids, 30, 1)
    df = spark.createDataFrame([(i,) for i in ids], ["h"])
    sizes = {r.part: r["count"] for r in design.split_weighted(df, "h", [("a", 72), ("b", 48), ("c", 48)], "s").groupBy("part").count().collect()}
    assert sizes == {"a": 13, "b": 9, "c": 8}  # 12, 8 and 8 of 30, and one more each for the first two


def test_balanced_values_and_states(spark):
    values = [f"v{i}" for i in range(12)]
    rows = design.crossed(spark.range(12), {"role": [0, 1, 2, 3]}).select("id", "role", design.balanced_value(F.col("id"), F.col("role"), values, 4).alias("v"))
    assert rows.groupBy("role", "v").count().filter("count <> 1").isEmpty() and rows.groupBy("id").agg(F.count_distinct("v").alias("n")).filter("n <> 4").isEmpty()
    states = ["a", "b", "c", "d"]
    for k in range(8):
        action, h, c = k & 1, k >> 1 & 1, k >> 2
        turn = (2 * action + 2 * h + c) % 4
        turned = states[turn:] + states[:turn]
        found = design.derived_states(F.array(*map(F.lit, states)), F.lit(action), F.lit(h), F.lit(c), ["EAST", "WEST"])
        r = spark.range(1).select(*(x.alias(n) for n, x in found.items())).first()
        assert r.policy == dict(zip(turned, ["EAST", "EAST", "WEST", "WEST"], strict=True)) and r.policy[r.current] == r.answer == r.policy[r.old_correct] != r.policy[r.old_wrong]
        assert (r.current, r.other_current, r.stratum) == (turned[2 * action], turned[(2 * action + 2) % 4], "aligned" if h == c else "reversed")


def test_group_folds_balance_like_the_greedy_rule(spark):
    sizes = {f"g{i}": n for i, n in enumerate([9, 7, 7, 7, 5, 5, 4, 3, 3, 3, 3, 2, 1, 1, 1, 1, 1])}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], ["g"])
    for k in (2, 3, 5):
        fold = {r.g: r.fold for r in predict.grouped_folds(df, "g", k).collect()}
        greedy = predict.greedy_folds(sizes, k)
        assert fold.keys() == sizes.keys()
        loads = lambda f: sorted(sum(n for g, n in sizes.items() if f[g] == t) for t in range(k))
        assert max(loads(fold)) - min(loads(fold)) <= max(loads(greedy)) - min(loads(greedy)) + 1


def test_incremental_gain_finds_a_planted_predictor(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(i, f"h{i % 20}", *map(float, x[i]), int(y[i])) for i in range(400)], ["id", "h", "a", "b", "y"])
    found = predict.compared(df, {"base": ["a"], "more": ["a", "b"]}, "y", "h", ["id"])
    gains = [r.gain for r in predict.incremental_gain(found, "h", "y", "p_base", "p_more").collect()]
    assert len(gains) == 20 and np.mean(gains) > 0.2
    p = {r.id: (r.p_base, r.p_more) for r in found.collect()}
    loss = [[-math.log(q if y[i] else 1 - q) for q in p[i]] for i in range(400) if i % 20 == 0]
    assert predict.incremental_gain(found, "h", "y", "p_base", "p_more").filter("h = 'h0'").first().gain == pytest.approx(np.mean([a - b for a, b in loss]))


def test_gates_count_prompts_once_and_fail_closed(spark):
    rows = spark.createDataFrame([("live", "p1", True, 1.0), ("live", "p1", True, 1.0), ("live", "p2", True, None), ("superseded", "p3", False, -1.0)], "c string, p string, ok boolean, m double")
    got = {r.c: r for r in gates.semantic_gate(rows, "c", ["p"], "ok", "m", ["live", "superseded", "absent"]).collect()}
    assert got["live"].passes and got["live"].prompts == 2 and got["superseded"].failed == ["accuracy_ok", "margin_ok"] and not got["absent"].passes
    assert {r.c: r.margin_ok for r in gates.semantic_gate(rows, "c", ["p"], "ok", "m", ["superseded"], []).collect()} == {"superseded": True}
    with pytest.raises(checks.ValidationError):
        gates.semantic_gate(rows.unionByName(rows.limit(1).withColumn("ok", F.lit(False))), "c", ["p"], "ok", "m", ["live"])
    chain = spark.createDataFrame([(1, 0.99)] * 32 + [(2, 0.99)] * 39 + [(3, 0.99)] * 47 + [(3, 0.9)], "depth int, a double")
    assert {r.depth: r.passes for r in gates.deep_chain_gate(chain, "depth", ["a"]).collect()} == {1: True, 2: False, 3: False}
    tasks = spark.createDataFrame([("current", 1)] * 97 + [("current", 0)] * 3 + [("historical", 0)], "task string, a int")
    assert {r.task: r.passes for r in gates.task_gate(tasks, "task", "a", ["current", "historical", "none"]).collect()} == {"current": True, "historical": False, "none": False}
    with pytest.raises(checks.ValidationError):
        gates.task_gate(tasks.withColumn("identity_transfer", F.lit(0)), "task", "a", ["current"], forbidden=["identity_transfer"])


def test_contracts_raise(spark):
    rows = spark.createDataFrame([("h", "accepted", "initial_x", "superseded_initial")], ["h", "c", "f", "s"])
    rules = {("accepted", "initial_x"): ("R_superseded_initial", "superseded_initial")}
    assert contrasts.status_metric(rows, rules, "c", "f", "s").first().metric == "R_superseded_initial"
    for bad in (rows.withColumn("s", F.lit("accepted_current")), rows.withColumn("f", F.lit("other"))):
        with pytest.raises(checks.ValidationError):
            contrasts.status_metric(bad, rules, "c", "f", "s")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], ["k", "role"])
    with pytest.raises(checks.ValidationError):
        joins.with_legend(twice.select("k"), twice, ["k"])
    with pytest.raises(checks.ValidationError):
        joins.validated_merge(twice, twice.limit(1), ["k"])
    with pytest.raises(checks.ValidationError):
        joins.with_row_count(twice, "k", 3)
    new, sealed = spark.createDataFrame([("h", "x")], ["h", "now"]), spark.createDataFrame([("h", "x")] * 2, ["h", "seal"])
    assert joins.sealed_with(new, sealed, "h", 2, "seal", "now").count() == 1
    for n, other in ((3, sealed), (2, sealed.withColumn("seal", F.lit("y"))), (3, sealed.union(spark.createDataFrame([("h", "z")], ["h", "seal"])))):
        with pytest.raises(checks.ValidationError):
            joins.sealed_with(new, other, "h", n, "seal", "now")
    with pytest.raises(checks.ValidationError):
        joins.metadata_of(twice, "k", ["role"])


def test_surface_events_fail_on_collisions_and_retokenized_prefixes(spark):
    df = spark.createDataFrame([("k", "say")], ["key", "prompt"])
    with pytest.raises(checks.ValidationError, match="collision"):
        tokens.surface_events(df, "key", "prompt", ["a", "b"], lambda texts: [[1, 2, 3][: 2 + (len(t) > 3)] for t in texts])
    with pytest.raises(checks.ValidationError, match="retokenized"):
        tokens.surface_events(df, "key", "prompt", ["a"], lambda texts: [[len(t)] * 3 for t in texts])
    merged = lambda texts: [[hash_ for w in t.lower().replace(" ", "|").split("|") for hash_ in [sum(map(ord, w)) + 1]] for t in texts]
    events = tokens.surface_events(df, "key", "prompt", ["red"], merged).collect()
    assert [sorted(r.surface_strings) for r in events] == [[" Red", " red"]]  # unspaced forms change the prompt's last token and are left out
    row = spark.range(1).select(tokens.covering_span(F.array(F.lit(0), F.lit(3), F.lit(6)), F.array(F.lit(3), F.lit(6), F.lit(9)), F.lit(4), F.lit(7)).alias("a"), tokens.covering_span(F.array(F.lit(0)), F.array(F.lit(3)), F.lit(5), F.lit(6)).alias("b")).first()
    assert row.a == [1, 2] and row.b is None


def test_grouped_probes_find_a_planted_direction(spark):
    rng = np.random.default_rng(1)
    rows = [("q", i, f"h{i % 15}", "xy"[i % 2], [float(v) for v in rng.normal(size=3) + 3 * (i % 2)]) for i in range(150)]
    df = spark.createDataFrame(rows, "query string, id int, h string, y string, v array<double>")
    r = probes.grouped_probes(df, ["query"], [("q",)], "v", "y", "h").first()
    assert r.n == 150 and r.accuracy > 0.95 and r.balanced_accuracy > 0.95 and r.log_loss < 0.3
    with pytest.raises(checks.ValidationError, match="misses a class"):
        probes.grouped_probes(df.withColumn("y", F.when(F.col("h") == "h1", "z").otherwise("x")), ["query"], [("q",)], "v", "y", "h")


def test_permuted_labels_keep_their_counts(spark):
    df = spark.createDataFrame([(str(i), float(i % 3 == 0)) for i in range(90)], ["__id", "label"])
    a, b = ({r["__id"]: r.label for r in probes.permuted(df, s).collect()} for s in (1, 2))
    assert sum(a.values()) == sum(b.values()) == 30 and a != b and a != {r["__id"]: r.label for r in df.collect()}


def test_json_flattening_and_plans(spark):
    texts = ['{"a": {"b": [1, {"c": 2.5}]}, "t": true, "s": "9", "n": null, "e": {}}', "[3, [4]]", "7", None, '"x"']
    got = {(r.i, r.path): r.value for r in records.flatten_json(spark.createDataFrame([*enumerate(texts)], "i long, t string"), "t", ["i"]).collect()}
    assert got == {(0, "a.b[0]"): 1.0, (0, "a.b[1].c"): 2.5, (1, "[0]"): 3.0, (1, "[1][0]"): 4.0, (2, ""): 7.0}
    lines = ["# Plan", "- status: lost", "### A1 first", "- status: done", "- deps: —", "text", "### B2", "- status: todo", "- deps: A1, Z9", "- status: claimed ", "### C3"]
    rows = records.plan_blocks(spark.createDataFrame([*enumerate(lines)], "ord long, line string").repartition(3)).orderBy("ord").collect()
    assert [(r.id, r.status, r.deps) for r in rows] == [("A1", "done", []), ("B2", "claimed", ["A1", "Z9"]), ("C3", None, [])]
    assert records.to_latex(spark.createDataFrame([("a_b & c%", 1.5)], ["n", "v"])).splitlines()[-1] == r"a\_b \& c\% & 1.500 \\"
    assert records.to_markdown(spark.createDataFrame([("a|b\nc", 1)], ["n", "v"])).splitlines()[-1] == r"| a\|b c | 1 |"


def test_chunks_and_canonical_files(spark, tmp_path):
    for k, n in enumerate((3, 2)):
        np.savez(tmp_path / f"chunk_{k}.npz", h=np.arange(n * 2, dtype=np.float16).reshape(n, 2) + 10 * k)
    rows = records.read_tensors(spark, [str(tmp_path / f"chunk_{k}.npz") for k in (1, 0)], "h")
    assert [(r.ord, r.vector[0]) for r in records.aligned_tensors(rows, 5).orderBy("ord").collect()] == [(0, 0.0), (1, 2.0), (2, 4.0), (3, 10.0), (4, 12.0)]
    with pytest.raises(ValueError, match="5 activation rows"):
        records.aligned_tensors(rows, 6)
    out = tmp_path / "rows"
    records.write_jsonl(spark.range(50).repartition(7).select(F.col("id").alias("z"), F.lit(None).cast("string").alias("a")), str(out), order="z")
    parts = list(out.glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[:2] == ['{"a":null,"z":0}', '{"a":null,"z":1}']


def test_settings_and_provenance(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"seed": 4}')
    (tmp_path / "x.py").write_bytes(b"abc")
    assert records.read_config(spark, str(tmp_path / "c.json")) == {"seed": 4}
    path = str(tmp_path / "x.py")
    assert lineage.code_hash(spark, [path]) == canonical({path: hashlib.sha256(b"abc").hexdigest()})
    found = lineage.provenance(spark, {"seed": 4}, path, ["numpy", "no such package"])
    assert found["dataset_sha256"] == hashlib.sha256(b"abc").hexdigest() and found["seed"] == 4 and found["packages"] == {"numpy": np.__version__, "no such package": None}
    assert json.dumps(found) and found["timestamp_utc"].endswith("Z")


def test_streamed_records_that_dont_belong_are_set_aside(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    data = spark.createDataFrame([("a",), ("b",)], ["example_id"])
    (tmp_path / "in" / "1.json").write_text('{"example_id":"a","s":1}\n{"example_id":"a","s":2}\n{"example_id":"zz","s":1}\n')
    append.append_once(spark, inbox, "example_id string, s int", data, out, mark).awaitTermination(60)
    (tmp_path / "in" / "2.json").write_text('{"example_id":"b","s":2}\n{"example_id":"a","s":1}\n')
    append.append_once(spark, inbox, "example_id string, s int", data, out, mark).awaitTermination(60)
    rejected = sorted((r.example_id, r.reason, r.batch) for r in spark.read.parquet(f"{out}_rejected").collect())
    assert rejected == [("a", "repeated", 0), ("a", "repeated", 1), ("zz", "unknown", 0)]
    assert lineage.bad_checksums(spark.read.parquet(out)).count() == 0
    assert {(r.example_id, r.expected, r.scored) for r in append.progress(spark.read.parquet(out), data, "example_id").collect()} == {("a", 1, 1), ("b", 1, 1)}
    (tmp_path / "in" / "3.json").write_text('{"example_id":"b","s":2}\n')
    with pytest.raises(Exception, match="unknown_or_repeated"):
        append.append_once(spark, inbox, "example_id string, s int", data, out, mark, strict=True).awaitTermination(60)


def test_a_cluster_needs_a_shared_folder():
    class Some:
        def __init__(self, **k):
            self.__dict__ |= k

    sc = Some(master="spark://host:7077", _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: Some(isDefined=lambda: False))))
    with pytest.raises(ValueError, match="share"):
        shared_checkpoints(Some(sparkContext=sc, conf=Some(get=lambda k, d: d)))
