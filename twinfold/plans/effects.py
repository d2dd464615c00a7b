"""Pair effects, contrasts and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, contrasts, joins
from ..operators import pairs as pair_ops
from .base import candidates, cells, families, family_pairs, pairs, query, r6, table, turns


@query("SELECT history, condition, round(effect, 6) AS effect, round(-effect, 6) AS shift FROM pairs", uses="cells pairs")
def pair_decision_shift(spark: SparkSession, sf: str) -> DataFrame:
    """effect: edited less baseline. shift: how much more a baseline leans to the wrong action, whose score the pair changes (the correct one's stays 0)."""
    p = pair_ops.paired(cells(spark, sf), ["history", "condition"], "member", ["score"])
    lean = lambda m: F.create_map(F.lit("wrong"), F.col(f"score_{m}"), F.lit("correct"), F.lit(0.0))
    return p.select("history", "condition", r6(F.col("score_1") - F.col("score_0"), "effect"), r6(pair_ops.decision_shift(lean(0), lean(1), F.lit("wrong"), F.lit("correct")), "shift"))


@query(
    """WITH m AS (SELECT user_id, event_type, avg(CASE WHEN day(ts) <= 15 THEN value END) AS b, avg(CASE WHEN day(ts) > 15 THEN value END) AS e FROM events GROUP BY ALL),
    w AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN b END) AS bs, max(CASE WHEN event_type = 'view' THEN b END) AS br, max(CASE WHEN event_type = 'click' THEN e END) AS es, max(CASE WHEN event_type = 'view' THEN e END) AS er FROM m GROUP BY ALL)
    SELECT user_id, round((er - es) - (br - bs), 6) AS effect, round(er - br, 6) AS replacement_change, round(es - bs, 6) AS source_change FROM w"""
)
def pair_identity_transfer(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    both = events.groupBy("user_id", "event_type").agg(*(F.avg(F.when(c, F.col("value"))).alias(n) for n, c in (("b", F.dayofmonth("ts") <= 15), ("e", F.dayofmonth("ts") > 15))))
    maps = both.groupBy("user_id").agg(*(F.map_from_entries(F.collect_list(F.struct("event_type", n))).alias(n) for n in "be"))
    found = pair_ops.identity_transfer(F.col("b"), F.col("e"), F.lit("click"), F.lit("view"))
    return maps.select("user_id", *(r6(x, n) for n, x in found.items()))


@query(
    "SELECT history, condition, CAST(CAST(s0 > s1 AS INTEGER) - CAST(s1 > s0 AS INTEGER) AS INTEGER) AS switch FROM (SELECT history, condition, max(CASE WHEN member = 0 THEN n END) AS s0, max(CASE WHEN member = 1 THEN n END) AS s1 FROM cells GROUP BY ALL)",
    uses="cells",
)
def net_switch_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = pair_ops.paired(cells(spark, sf), ["history", "condition"], "member", ["n"])
    return p.select("history", "condition", pair_ops.net_switch(F.col("n_0") > F.col("n_1"), F.col("n_1") > F.col("n_0")).alias("switch"))


@query(
    """SELECT o_orderkey AS id, round(CASE WHEN o_orderstatus <> 'P' THEN (e1 - s1) - (e0 - s0) END, 6) AS margin_change, CASE WHEN abs(e1 - s1) > 1e-6 THEN round((e0 - s1) / (e1 - s1), 6) END AS recovery
    FROM (SELECT o_orderkey, o_orderstatus, avg(l_extendedprice) AS e1, avg(l_quantity) AS s1, avg(l_discount) AS e0, avg(l_tax) AS s0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
)
def pair_margin_and_recovery(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("e1"), F.avg("l_quantity").alias("s1"), F.avg("l_discount").alias("e0"), F.avg("l_tax").alias("s0"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    c = F.col
    return both.select(c("o_orderkey").alias("id"), r6(pair_ops.margin_change(c("e0"), c("s0"), c("e1"), c("s1"), c("o_orderstatus") != "P"), "margin_change"), r6(pair_ops.normalized_recovery(c("e0"), c("e1"), c("s1")), "recovery"))


@query(
    """WITH e AS (SELECT l_suppkey AS history, l_returnflag AS edited, l_linestatus AS query, avg(l_extendedprice) AS x FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL),
    w AS (SELECT history, max(CASE WHEN edited = 'A' AND query = 'F' THEN x END) AS xx, max(CASE WHEN edited = 'A' AND query = 'O' THEN x END) AS xz, max(CASE WHEN edited = 'N' AND query = 'O' THEN x END) AS zz, max(CASE WHEN edited = 'N' AND query = 'F' THEN x END) AS zx FROM e GROUP BY ALL)
    SELECT history, round(((xx - xz) + (zz - zx)) / 2, 6) AS relevance FROM w"""
)
def relevance_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "N"))
    # the two axes' names are the edits' and the queries': A is asked by F, N by O
    named = items.select(F.col("l_suppkey").alias("history"), F.when(F.col("l_returnflag") == "A", "x").otherwise("z").alias("edited"), F.when(F.col("l_linestatus") == "F", "x").otherwise("z").alias("query"), F.col("l_extendedprice").alias("value"))
    return contrasts.symmetric_relevance(named, ["history"], "edited", "query", "value", ("x", "z")).select("history", r6("relevance", "relevance"))


@query(
    """WITH o AS (SELECT l_suppkey AS history, CASE WHEN l_linenumber % 2 = 0 THEN 'aligned' ELSE 'reversed' END AS stratum, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS m, l_extendedprice AS v FROM lineitem),
    b AS (SELECT * FROM o UNION ALL SELECT history, 'all', m, v FROM o)
    SELECT history, stratum, round(avg(CASE WHEN m = 1 THEN v END) - avg(CASE WHEN m = 0 THEN v END), 6) AS effect FROM b GROUP BY ALL"""
)
def relevance_by_order(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("history"), F.when(F.col("l_linenumber") % 2 == 0, "aligned").otherwise("reversed").alias("stratum"), F.col("l_linestatus").alias("m"), F.col("l_extendedprice").alias("v"))
    both = contrasts.with_all(items, "stratum")
    return both.groupBy("history", "stratum").agg(r6(contrasts.cell_mean(F.col("m") == "O", "v") - contrasts.cell_mean(F.col("m") == "F", "v"), "effect"))


@query(
    """WITH w AS (SELECT history, max(CASE WHEN condition = 'A' AND member = 1 THEN score END) - max(CASE WHEN condition = 'A' AND member = 0 THEN score END) AS a, max(CASE WHEN condition = 'R' AND member = 1 THEN score END) - max(CASE WHEN condition = 'R' AND member = 0 THEN score END) AS b FROM cells GROUP BY ALL)
    SELECT history, round(a, 6) AS effect_first, round(b, 6) AS effect_second, round(a - b, 6) AS interaction FROM w""",
    uses="cells",
)
def factorial_interaction(spark: SparkSession, sf: str) -> DataFrame:
    found = contrasts.factorial(cells(spark, sf), ["history"], "member", (0, 1), "condition", ("A", "R"), "score")
    return found.select("history", *(r6(c, c) for c in ("effect_first", "effect_second", "interaction")))


@query(
    """WITH w AS (SELECT history, max(CASE WHEN family = 'click' THEN effect END) AS c, max(CASE WHEN family = 'view' THEN effect END) AS v, max(CASE WHEN family = 'error' THEN effect END) AS e FROM family_pairs GROUP BY ALL)
    SELECT history, round(c - v, 6) AS click_minus_view, round(c - e, 6) AS click_minus_error FROM w""",
    uses="families family_pairs",
)
def construction_deltas(spark: SparkSession, sf: str) -> DataFrame:
    wide = contrasts.pivot_cells(family_pairs(spark, sf), ["history"], "family", {"c": "click", "v": "view", "e": "error"}, "effect")
    return wide.select("history", r6(F.col("c") - F.col("v"), "click_minus_view"), r6(F.col("c") - F.col("e"), "click_minus_error"))


@query(
    """SELECT history, round(avg(CASE WHEN condition = 'A' THEN effect END) - avg(CASE WHEN condition = 'N' THEN effect END), 6) AS reactivation FROM pairs GROUP BY ALL""", uses="cells pairs"
)
def reactivation_delta(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).groupBy("history").agg(r6(contrasts.cell_mean(F.col("condition") == "A", "effect") - contrasts.cell_mean(F.col("condition") == "N", "effect"), "reactivation"))


@query("SELECT conv_id, turn, size - lag(size) OVER (PARTITION BY conv_id ORDER BY turn) AS current_minus_previous FROM turns", uses="turns")
def chain_adjacent_versions(spark: SparkSession, sf: str) -> DataFrame:
    return contrasts.version_contrasts(turns(spark, sf), ["conv_id"], "turn", "size").select("conv_id", "turn", "current_minus_previous")


@query(
    "SELECT conv_id, turn, round(lag(size) OVER (PARTITION BY conv_id ORDER BY turn) - avg(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 6) AS previous_minus_older FROM turns", uses="turns"
)
def chain_previous_vs_older(spark: SparkSession, sf: str) -> DataFrame:
    return contrasts.version_contrasts(turns(spark, sf), ["conv_id"], "turn", "size").select("conv_id", "turn", r6("previous_minus_older", "previous_minus_older"))


_LAYERS = "layers AS (SELECT o_custkey AS history, CAST(month(o_orderdate) AS INTEGER) AS layer, o_totalprice AS v FROM orders)"


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("history"), F.month("o_orderdate").alias("layer"), F.col("o_totalprice").alias("v"))


@query(
    f"""WITH {_LAYERS}, k AS (SELECT count(DISTINCT layer) AS k FROM layers), full_ AS (SELECT history FROM layers GROUP BY 1 HAVING count(DISTINCT layer) = (SELECT k FROM k)),
    m AS (SELECT layer, avg(v) AS m FROM layers WHERE history IN (SELECT history FROM full_) GROUP BY 1),
    w AS (SELECT layer AS first_layer, avg(m) OVER (ORDER BY layer ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS window_mean, count(*) OVER (ORDER BY layer ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM m)
    SELECT first_layer, round(window_mean, 4) AS window_mean FROM w WHERE k = 3 ORDER BY window_mean DESC, first_layer LIMIT 1"""
)
def best_window(spark: SparkSession, sf: str) -> DataFrame:
    return contrasts.best_window(_layers(spark, sf), "history", "layer", "v", 3).select("first_layer", F.round("window_mean", 4).alias("window_mean"))


@query(
    f"""WITH {_LAYERS}, m AS (SELECT layer, avg(v) AS m FROM layers GROUP BY 1), l AS (SELECT m AS late FROM m ORDER BY layer DESC LIMIT 1)
    SELECT min(CASE WHEN m >= 0.25 * late THEN layer END) AS first_25, min(CASE WHEN m >= 1.0 * late THEN layer END) AS first_100, (SELECT layer FROM m ORDER BY abs(m) DESC, layer LIMIT 1) AS peak_layer FROM m, l"""
)
def depth_crossing(spark: SparkSession, sf: str) -> DataFrame:
    return contrasts.depth_crossings(_layers(spark, sf), "layer", "v", (0.25, 1.0))


@query(
    f"WITH {_LAYERS} SELECT history, round(avg(CASE WHEN (layer - 1) / 11.0 >= 0.75 THEN v END) - avg(CASE WHEN (layer - 1) / 11.0 <= 0.25 THEN v END), 4) AS late_minus_early FROM layers GROUP BY ALL"
)
def depth_windows(spark: SparkSession, sf: str) -> DataFrame:
    deep = _layers(spark, sf).withColumn("depth", (F.col("layer") - 1) / F.lit(11.0))
    return contrasts.depth_window_contrast(deep, ["history"], "depth", "v").select("history", F.round("late_minus_early", 4).alias("late_minus_early"))


@query(
    """WITH p AS (SELECT l_suppkey AS head, l_shipmode_ AS query, l_linestatus AS direction, l_linenumber AS position, avg(l_extendedprice) AS p FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY ALL),
    d AS (SELECT head, query, direction, avg(p) AS d FROM p GROUP BY ALL), q AS (SELECT head, query, avg(d) AS q FROM d GROUP BY ALL)
    SELECT head, round(avg(CASE WHEN query = 'R' THEN q END) - avg(CASE WHEN query <> 'R' THEN q END), 4) AS relevant_minus_other FROM q GROUP BY ALL"""
)
def head_profile_pivot(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("head"), F.col("l_returnflag").alias("query"), F.col("l_linestatus").alias("direction"), F.col("l_linenumber").alias("position"), F.col("l_extendedprice").alias("v"))
    return contrasts.head_profiles(items, ["head"], "position", "direction", "query", "R", "v").select("head", F.round("relevant_minus_other", 4).alias("relevant_minus_other"))


@query("SELECT o_orderkey AS id, round(parts, 2) AS parts, round(o_totalprice, 2) AS whole, round(parts - o_totalprice, 2) AS difference FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def sum_vs_whole(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("v"))
    whole = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return contrasts.parts_against_whole(parts, whole, ["id"], "v").select("id", *(F.round(c, 2).alias(c) for c in ("parts", "whole", "difference")))


@query(
    """WITH d AS (SELECT l_suppkey AS history, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) AS d0, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END) AS d1 FROM lineitem GROUP BY ALL)
    SELECT history, round((d0 + d1) / 4, 4) AS position_effect, round((d0 - d1) / 4, 4) AS name_effect FROM d"""
)
def position_factorial(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("history"), (F.col("l_linenumber") % 2).alias("orientation"), F.col("l_extendedprice").alias("v"))
    return contrasts.position_factorial(items, ["history"], "orientation", "v").select("history", *(F.round(c, 4).alias(c) for c in ("position_effect", "name_effect")))


# ---- joins


@query("SELECT count(*) AS events_missing, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = a.l_orderkey)) AS lines_extra FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def coverage_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.coverage(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")
    return found.select(F.col("missing").alias("events_missing"), F.col("extra").alias("lines_extra"))


@query(
    """WITH f AS (SELECT doc_id, count(*) AS violations FROM documents GROUP BY 1), x AS (SELECT CASE WHEN d.lang IS DISTINCT FROM e.lang THEN 'lang' END AS a, CASE WHEN d.n_chars IS DISTINCT FROM e.n_chars THEN 'n_chars' END AS b FROM documents d JOIN (SELECT doc_id - 1 AS doc_id, lang, n_chars FROM documents) e USING (doc_id)),
    y AS (SELECT a AS c FROM x UNION ALL SELECT b FROM x) SELECT c AS "column", count(*) AS violations FROM y WHERE c IS NOT NULL GROUP BY 1"""
)
def metadata_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return checks.mismatches(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", ["lang", "n_chars"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return checks.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).violations


@query(
    """WITH d AS (SELECT DISTINCT family, member FROM families), h AS (SELECT DISTINCT history FROM families)
    SELECT h.history, d.family, d.member FROM h CROSS JOIN d LEFT JOIN families f ON f.history = h.history AND f.family = d.family AND f.member = d.member WHERE f.history IS NULL""",
    uses="families",
)
def factorial_missing_cells(spark: SparkSession, sf: str) -> DataFrame:
    return checks.missing_cells(families(spark, sf), "history", ["family", "member"])


@query("SELECT min(n) AS least, max(n) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def balance_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.balanced(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT DISTINCT sha256(text) AS signature FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1) AND doc_id % 2 = 0")
def leakage_overlap(spark: SparkSession, sf: str) -> DataFrame:
    signed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("signature"))
    return checks.overlap(signed.filter("doc_id % 2 = 0"), signed.filter("doc_id % 2 = 1"), "signature")


@query("SELECT history, count(*) AS n FROM families WHERE history IN (SELECT history FROM families GROUP BY 1 HAVING bool_and(score > 20)) GROUP BY ALL", uses="families")
def tracked_histories_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Cells without values count neither way. The order of three values or more decides whether a mean of 20 sums up to a little more, so the
    SQL's answer there hangs on its threads: such means are compared as exact decimals. Values that are none (NaN, 1e20) are taken as floats."""
    n, mean, exact = F.count("value"), F.avg("value"), F.col("value").try_cast("decimal(38, 18)")
    above = F.coalesce(F.when((n > 2) & (F.count(exact) == n), F.try_sum(exact) > 20 * n), mean > 20)
    return joins.where_all(families(spark, sf, above.alias("above")), "history", F.col("above"), unknown=True).groupBy("history").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT history FROM families WHERE member = 1 AND family IN ('click', 'view') GROUP BY 1 HAVING count(DISTINCT family) = 2)
    SELECT history, round(avg(score), 6) AS mean FROM families WHERE member = 1 AND family IN ('click', 'view') AND history IN (SELECT history FROM f) GROUP BY 1""",
    uses="families",
)
def cell_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return joins.with_all_cells(families(spark, sf).filter("member = 1"), "history", "family", ["click", "view"]).groupBy("history").agg(r6(F.avg("score"), "mean"))


@query(
    """SELECT a.history, round(a.effect - b.effect, 6) AS paired_difference FROM pairs a JOIN pairs b ON a.history = b.history AND a.condition = 'A' AND b.condition = 'R'""", uses="cells pairs"
)
def paired_effect_difference(spark: SparkSession, sf: str) -> DataFrame:
    wide = contrasts.pivot_cells(pairs(spark, sf), ["history"], "condition", {"a": "A", "b": "R"}, "effect")
    return wide.filter("a is not null and b is not null").select("history", r6(F.col("a") - F.col("b"), "paired_difference"))


@query("SELECT c_custkey, n_name, r_name, round(c_acctbal, 2) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def history_metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.metadata_of(named, "c_custkey", ["n_name", "r_name", "c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    """WITH a AS (SELECT role, count(*) AS n FROM conversations WHERE turn = 0 GROUP BY 1), b AS (SELECT role, count(*) AS n FROM conversations WHERE turn > 4 GROUP BY 1)
    SELECT coalesce(a.role, b.role) AS role, a.n AS first_turns, b.n AS late_turns FROM a FULL OUTER JOIN b ON a.role = b.role"""
)
def outer_legend_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    a, b = (c.filter(w).groupBy("role").agg(F.count("*").alias(n)) for w, n in (("turn = 0", "first_turns"), ("turn > 4", "late_turns")))
    return a.join(b, "role", "full_outer")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY min(event_id), user_id LIMIT 20) GROUP BY 1")
def independent_first_k_histories(spark: SparkSession, sf: str) -> DataFrame:
    return joins.first_histories(table(spark, sf, "events"), "user_id", "event_id", 20).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT p_type, string_split(p_type, ' ') AS w FROM part), s AS (SELECT DISTINCT p_brand, string_split(p_brand, '#') AS w FROM part), u AS (SELECT p_type AS k, w FROM t UNION SELECT p_type || ' X', list_append(w, 'X') FROM t)
    SELECT a.k AS shorter, b.k AS longer FROM u a JOIN u b ON len(a.w) < len(b.w) AND b.w[1:len(a.w)] = a.w"""
)
def candidate_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_type").alias("k"), F.split("p_type", " ").alias("w")).distinct()
    longer = t.select(F.concat("k", F.lit(" X")).alias("k"), F.array_append("w", F.lit("X")).alias("w"))
    return joins.proper_prefixes(t.unionByName(longer).distinct(), "k", "w")


@query(
    """SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) = max(CAST(l_linenumber AS BIGINT))"""
)
def recover_complete_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.records import complete_units

    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("n"))
    known = lines.join(table(spark, sf, "orders").select("o_orderkey").hint("merge"), "o_orderkey", "left_semi")
    return complete_units(known, "o_orderkey", F.col("n")).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT list_extract(v, answer + 1) AS score, vec_id FROM candidates", uses="candidates")
def array_lookup_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select(F.get("v", F.col("answer")).alias("score"), "vec_id")


@query(
    "WITH x AS (SELECT l_partkey AS id, l_returnflag || l_linestatus AS role FROM lineitem) SELECT id, array_to_string(list_sort(list_distinct(list(role))), '|') AS roles FROM x GROUP BY 1"
)
def role_sets(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("role"))
    return x.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))


@query(
    "SELECT history, name, value FROM (SELECT history, round(max(CASE WHEN condition = 'A' THEN effect END), 6) AS effect_a, round(max(CASE WHEN condition = 'N' THEN effect END), 6) AS effect_n FROM pairs GROUP BY 1) UNPIVOT INCLUDE NULLS (value FOR name IN (effect_a, effect_n))",
    uses="cells pairs",
)
def melt_effects(spark: SparkSession, sf: str) -> DataFrame:
    wide = contrasts.pivot_cells(pairs(spark, sf), ["history"], "condition", {"effect_a": "A", "effect_n": "N"}, "effect")
    rounded = wide.select("history", r6("effect_a", "effect_a"), r6("effect_n", "effect_n"))
    return rounded.unpivot("history", ["effect_a", "effect_n"], "name", "value")


