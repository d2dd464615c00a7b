"""Aggregations, ranks, parses, gates, resampling and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, stats, text
from ..operators import design, gates, grouping, ordered, predict, resample, streams
from ..sources.records import flatten_json, text_tail
from .base import candidates, cells, families, family_pairs, pairs, query, r6, table

_MARGINS = "margins AS (SELECT vec_id, label, v[answer + 1] - list_max(list_concat(v[1:answer], v[answer + 2:8])) AS margin, v[answer + 1] >= list_max(v) AS hit FROM candidates)"


@query("SELECT condition, CAST(count(*) AS BIGINT) AS histories, round(avg(m), 6) AS score FROM (SELECT history, condition, avg(score) AS m FROM cells GROUP BY ALL) GROUP BY 1", uses="cells")
def two_level_rate(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.two_level_mean(cells(spark, sf), ["condition"], "history", "score").select("condition", "histories", r6("score", "score"))


@query("SELECT lang, source, text_id, n_chars FROM (SELECT lang, source, md5(text) AS text_id, max(n_chars) AS n_chars FROM documents GROUP BY ALL)")
def unique_prompt_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "source", F.md5("text").alias("text_id"), "n_chars")
    return grouping.distinct_prompts(docs, ["lang", "source", "text_id"], ["n_chars"])


@query(
    """SELECT lang, source, CASE WHEN grouping(lang) = 0 AND grouping(source) = 0 THEN 'lang,source' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level, count(*) AS n, round(avg(n_chars), 6) AS mean_chars
    FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())"""
)
def strata_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    found = grouping.grouping_sets(table(spark, sf, "documents"), [["lang", "source"], ["lang"], ["source"], []], [F.count("*").alias("n"), r6(F.avg("n_chars"), "mean_chars")])
    return found.select("lang", "source", "level", "n", "mean_chars")


@query(
    """WITH m AS (SELECT user_id, list_distinct(list(event_type)) AS kinds, avg(value) AS v FROM events GROUP BY 1)
    SELECT kind, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT unnest(kinds) AS kind, v FROM m) GROUP BY 1"""
)
def overlap_membership(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.avg("value").alias("v"))
    return grouping.overlapping(m, "kinds", "kind").groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


@query(
    """WITH s AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
    SELECT event_type AS before, after, count(*) AS n FROM s WHERE after IS NOT NULL GROUP BY ALL"""
)
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("before"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("after"))
    return grouping.transitions(e.filter("after is not null"), [], "before", "after")


_TRIM = "s AS (SELECT condition, effect, row_number() OVER (PARTITION BY condition ORDER BY effect) - 1 AS i, count(*) OVER (PARTITION BY condition) AS n FROM pairs WHERE effect IS NOT NULL)"


@query(f"WITH {_TRIM} SELECT condition, round(avg(effect), 6) AS trimmed FROM s WHERE i >= floor(n * 0.1) AND i < n - floor(n * 0.1) GROUP BY 1", uses="cells pairs")
def trimmed_mean_both(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.order_statistics(pairs(spark, sf), ["condition"], "effect").select("condition", r6("trimmed", "trimmed"))


@query(f"WITH {_TRIM} SELECT condition, round(avg(effect), 6) AS trimmed FROM s WHERE i >= floor(n * 0.1) AND i < ceil(n * 0.9) GROUP BY 1", uses="cells pairs")
def trimmed_mean_asym(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.order_statistics(pairs(spark, sf), ["condition"], "effect").select("condition", r6("trimmed_asymmetric", "trimmed"))


@query(
    f"WITH {_TRIM} SELECT condition, round(max(CASE WHEN i = n // 2 THEN effect END), 6) AS upper_median, round(max(CASE WHEN i = CAST(floor((n - 1) * 0.95) AS BIGINT) THEN effect END), 6) AS p95, round(median(effect), 6) AS median FROM s GROUP BY 1",
    uses="cells pairs",
)
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.order_statistics(pairs(spark, sf), ["condition"], "effect").select("condition", r6("upper_median", "upper_median"), r6("p95", "p95"))
    return found.join(pairs(spark, sf).groupBy("condition").agg(r6(F.median("effect"), "median")), "condition")


@query("SELECT condition, round(quantile_cont(effect, 0.25), 6) AS q25, round(quantile_cont(effect, 0.75), 6) AS q75, round(avg(CAST(effect > 0 AS DOUBLE)), 6) AS fraction_positive FROM pairs GROUP BY 1", uses="cells pairs")
def quantiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).groupBy("condition").agg(r6(F.percentile("effect", 0.25), "q25"), r6(F.percentile("effect", 0.75), "q75"), r6(stats.fraction_positive(F.col("effect")), "fraction_positive"))


@query("SELECT c_mktsegment AS segment, rate FROM (SELECT c_mktsegment, round(avg(CAST(c_acctbal > 5000 AS DOUBLE)), 9) AS rate FROM customer GROUP BY 1) ORDER BY rate, segment LIMIT 1")
def lowest_group(spark: SparkSession, sf: str) -> DataFrame:
    rates = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.avg((F.col("c_acctbal") > 5000).cast("double")), 9).alias("rate"))
    return grouping.lowest_group(rates, "segment", "rate")


@query(
    "SELECT l_returnflag AS condition, round(avg(l_extendedprice), 4) AS numerator, round(avg(l_quantity), 6) AS denominator, CASE WHEN avg(l_quantity) > 1 THEN round(avg(l_extendedprice) / avg(l_quantity), 6) END AS ratio FROM lineitem GROUP BY 1"
)
def ratio_of_means(spark: SparkSession, sf: str) -> DataFrame:
    found = grouping.ratio_of_means(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "condition"), ["condition"], "l_extendedprice", "l_quantity", 1.0)
    return found.select("condition", F.round("numerator", 4).alias("numerator"), r6("denominator", "denominator"), r6("ratio", "ratio"))


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, first_seen, lang) AS INTEGER) AS place FROM c)
    SELECT source, lang, n, first_seen, place FROM r WHERE place <= 2"""
)
def topk_wrong(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.top_k(table(spark, sf, "documents"), ["source"], "lang", "doc_id", 2)


# ---- ranks and scores


@query("SELECT vec_id, CAST(1 + len(list_filter(list_concat(v[1:answer], v[answer + 2:8]), lambda x: x >= v[answer + 1])) AS INTEGER) AS rank FROM candidates", uses="candidates")
def strict_rank(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("vec_id", scores.strict_rank(F.col("v"), F.col("answer")).alias("rank"))


@query("SELECT vec_id, CAST(1 + len(list_filter(v, lambda x: x > v[answer + 1])) AS INTEGER) AS rank, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best FROM candidates", uses="candidates")
def lenient_rank(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("vec_id", scores.lenient_rank(F.col("v"), F.col("answer")).alias("rank"), scores.argmax_first(F.col("v")).alias("best"))


@query("SELECT vec_id, round(v[answer + 1] - list_max(list_concat(v[1:answer], v[answer + 2:8])), 6) AS margin FROM candidates", uses="candidates")
def strongest_competitor_margin(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("vec_id", r6(scores.competitor_margin(F.col("v"), F.col("answer")), "margin"))


@query("SELECT vec_id, round(exp(v[answer + 1]) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS p FROM candidates", uses="candidates")
def candidate_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("vec_id", r6(F.get(scores.softmax(F.col("v")), F.col("answer")), "p"))


@query("SELECT vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS mass FROM candidates", uses="candidates")
def logsumexp_mass(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("vec_id", r6(scores.logsumexp(F.col("v")), "mass"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS p FROM candidates),
    m AS (SELECT vec_id, unnest(p) AS a, unnest(list_reverse(p)) AS b FROM p)
    SELECT vec_id, round(sum(a * (ln(a + 1e-12) - ln((a + b) / 2 + 1e-12)) + b * (ln(b + 1e-12) - ln((a + b) / 2 + 1e-12))) / 2, 6) AS js FROM m GROUP BY 1""",
    uses="candidates",
)
def js_divergence(spark: SparkSession, sf: str) -> DataFrame:
    p = candidates(spark, sf).select("vec_id", scores.softmax(F.col("v")).alias("p"))
    return p.select("vec_id", r6(scores.js_divergence(F.col("p"), F.reverse("p")), "js"))


@query("SELECT vec_id, round(v[1] - v[2], 6) AS old_contrast, round(v[3] - v[4], 6) AS current_contrast, round(v[3] - greatest(v[1], v[2], v[4]), 6) AS margin FROM candidates", uses="candidates")
def role_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    found = scores.role_contrasts(*(F.get("v", i) for i in (0, 1, 2, 3)))
    return candidates(spark, sf).select("vec_id", *(r6(x, n) for n, x in found.items()))


#: White space of any script, as in functions/text.py.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = rf"regexp_replace(regexp_replace({{0}}, '^{_WHITE.replace('{', '{{').replace('}', '}}')}+', ''), '{_WHITE.replace('{', '{{').replace('}', '}}')}+\z', '')"
_LABELS = (
    r"""WITH h AS (SELECT conv_id, turn, """ + _STRIP.format("chr(9) || role || chr(10)") + r""" AS role, regexp_matches(text, '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|\z)') AS a, regexp_matches(text, '(^|[^\p{L}\p{N}_])and([^\p{L}\p{N}_]|\z)') AS b FROM conversations)
    SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role END AS strict, CASE WHEN a AND NOT b THEN 'the' WHEN b AND NOT a THEN 'and' END AS relaxed"""
)
#: The sharp s is the one letter of these texts whose folded form isn't its small one.
_ANSWERS = r"""SELECT conv_id, turn, replace(lower(regexp_replace(regexp_replace(t, '^[\x20"''`.,;:!?]+', ''), '[\x20"''`.,;:!?]+\z', '')), 'ß', 'ss') AS answer, CASE WHEN starts_with(lower(text), 'the') THEN 'The' WHEN starts_with(lower(text), 'and') THEN 'And' END AS starts_with
    FROM (SELECT *, """ + _STRIP.format("text") + r""" AS t FROM conversations)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Roles with a tab before and a line end behind, parsed strictly; texts searched for one of two words."""
    c = table(spark, sf, "conversations").withColumn("role", F.concat(F.lit("\t"), "role", F.lit("\n")))
    return c.select("conv_id", "turn", text.strict_label(F.col("role"), ["user", "assistant"]).alias("strict"), text.relaxed_label(F.col("text"), ["the", "and"]).alias("relaxed"), text.label_class(F.col("role"), ["user", "assistant"], F.lit("user"), F.col("turn") < 3).alias("label"))


@query(_LABELS + ", CASE WHEN role IS NULL OR turn >= 3 OR role NOT IN ('user', 'assistant') THEN 'invalid' WHEN role = 'user' THEN 'correct' ELSE 'wrong' END AS label FROM h")
def strict_relaxed_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf)


@query(_ANSWERS)
def complete_answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.complete_answer(F.col("text")).alias("answer"), text.prefix_candidate(F.col("text"), ["The", "And"]).alias("starts_with"))


@query(_LABELS + " FROM h")
def strict_relaxed_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    """strict_relaxed_parse without the class of the label."""
    return _labelled(spark, sf).drop("label")


@query(_ANSWERS)
def complete_answer_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same as complete_answer_parse, under its former name."""
    return complete_answer_parse(spark, sf)


@query(
    """SELECT doc_id, CASE WHEN a = lower(source) || 'ss' THEN 'correct' WHEN a = 'src0ss' THEN 'stale' ELSE 'other' END AS category
    FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN upper(source) || 'SS' WHEN 1 THEN 'SRC0SS' ELSE lang END AS x FROM documents), LATERAL (SELECT lower(x) AS a)"""
)
def answer_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in capitals, where the sharp s is two letters, against expected ones in small letters."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(' "'), F.upper("source"), F.lit('SS!" '))).when(F.col("doc_id") % 3 == 1, "SRC0SS.").otherwise(F.col("lang")).alias("x"))
    return d.select("doc_id", text.answer_class(F.col("x"), F.concat("source", F.lit("\u00df")), F.lit("src0\u00df")).alias("category"))


@query(
    """WITH t AS (SELECT doc_id, substr(text, 1, length(text) * 2 // 3) AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, t, string_split(t, chr(10))[-1] AS tail FROM t)
    SELECT doc_id, strlen(t) - strlen(tail) AS offset, strlen(tail) AS length, sha256(tail) AS sha256 FROM x WHERE tail <> ''"""
)
def truncated_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut off at two thirds, as an interrupted writer leaves a file: what stands behind the last line end."""
    cut = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.expr("substring(text, 1, CAST(length(text) * 2 DIV 3 AS INT))").alias("t"))
    return cut.select("doc_id", text_tail(F.col("t")).alias("tail")).filter("tail is not null").select("doc_id", "tail.*")


@query(f"WITH {_MARGINS} SELECT vec_id, CASE WHEN hit THEN 'correct' WHEN margin > -0.1 THEN 'near' WHEN label > 7 THEN 'outside' ELSE 'far' END AS kind FROM margins", uses="candidates")
def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    m = candidates(spark, sf).withColumn("margin", scores.competitor_margin(F.col("v"), F.col("answer")))
    kind = F.when(F.get("v", F.col("answer")) >= F.array_max("v"), "correct").when(F.col("margin") > -0.1, "near").when(F.col("label") > 7, "outside").otherwise("far")
    return m.select("vec_id", kind.alias("kind"))


@query("SELECT page_id, CAST(greatest(0, strpos(html, '<body') - strpos(html, '</title>') - 8) AS INTEGER) AS gap FROM pages WHERE html IS NOT NULL")
def span_gap(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").filter("html is not null")
    return p.select("page_id", text.span_gap(F.instr("html", "</title>") + 8, F.instr("html", "<body")).alias("gap"))


@query("SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_json(table(spark, sf, "events"), "props", ["event_id"])


# ---- gates

_GATE = "g AS (SELECT label, avg(CAST(hit AS DOUBLE)) AS accuracy, avg(margin) AS margin FROM margins GROUP BY 1)"


def _gate_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).select("label", (F.get("v", F.col("answer")) >= F.array_max("v")).cast("double").alias("hit"), scores.competitor_margin(F.col("v"), F.col("answer")).alias("margin"))
    return c.groupBy("label").agg(F.avg("hit").alias("accuracy"), F.avg("margin").alias("margin"))


@query(
    f"""WITH {_MARGINS}, {_GATE} SELECT label, round(accuracy, 6) AS accuracy, accuracy >= 0.1 AND margin > -0.2 AS passes, concat_ws(',', CASE WHEN accuracy < 0.1 THEN 'accuracy_ok' END, CASE WHEN margin <= -0.2 THEN 'margin_ok' END) AS failed FROM g""",
    uses="candidates",
)
def gate_cells(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.cell_gate(_gate_cells(spark, sf), {"accuracy_ok": F.col("accuracy") >= 0.1, "margin_ok": F.col("margin") > -0.2})
    return found.select("label", r6("accuracy", "accuracy"), "passes", F.array_join("failed", ",").alias("failed"))


@query(f"""WITH {_MARGINS}, {_GATE} SELECT label, bool_and(accuracy >= 0.1) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM g""", uses="candidates")
def gate_prefix_depth(spark: SparkSession, sf: str) -> DataFrame:
    passed = _gate_cells(spark, sf).withColumn("passes", F.col("accuracy") >= 0.1).withColumn("g", F.lit(0))
    return gates.prefix_gate(passed, ["g"], "label").select("label", "open")


@query(
    f"""WITH {_MARGINS}, {_GATE}, r AS (SELECT label, accuracy, accuracy BETWEEN 0.1 AND 0.13 AS inside FROM g)
    SELECT label, round(accuracy, 6) AS accuracy, inside AS in_window FROM r ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE abs(accuracy - 0.115) END, CASE WHEN inside THEN -label ELSE label END LIMIT 1""",
    uses="candidates",
)
def gate_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    return gates.pick_difficulty(_gate_cells(spark, sf), "label", "accuracy", 0.1, 0.13, 0.115).select("label", r6("accuracy", "accuracy"), "in_window")


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_custkey AS dep, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS status FROM orders)
    SELECT min(id) AS id FROM p WHERE status = 'todo' AND EXISTS (SELECT 1 FROM p q WHERE q.id = p.dep AND q.status = 'done')"""
)
def next_plan_step(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.array("o_custkey").alias("deps"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("todo").alias("status"))
    return gates.next_step(plan)


# ---- resampling: SQL repeats the md5 draws

_DRAWS = """x AS (SELECT family AS g, history, effect, row_number() OVER (PARTITION BY family ORDER BY history) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM family_pairs WHERE effect IS NOT NULL),
    z AS (SELECT DISTINCT g, n FROM x), d AS (SELECT g, n, unnest(range({draws})) AS draw FROM z), s AS (SELECT g, n, draw, unnest(range(n)) AS slot FROM d),
    t AS (SELECT g, draw, CAST('0x' || substr(md5('{seed}:' || draw || ':' || slot), 1, 8) AS BIGINT) % n AS i FROM s)"""


def _effects(spark: SparkSession, sf: str) -> DataFrame:
    return family_pairs(spark, sf).filter("effect is not null").withColumnRenamed("family", "g")


@query(
    f"WITH {_DRAWS.format(draws=100, seed='81004')}, m AS (SELECT t.g, draw, avg(effect) AS m FROM t JOIN x ON x.g = t.g AND x.i = t.i GROUP BY ALL), q AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) SELECT q.g, round(a, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 THEN 'positive' WHEN high < 0 THEN 'negative' ELSE 'includes_zero' END AS verdict FROM q JOIN (SELECT g, avg(effect) AS a FROM x GROUP BY 1) y ON y.g = q.g",
    uses="families family_pairs",
)
def bootstrap_mean_portable(spark: SparkSession, sf: str) -> DataFrame:
    found = resample.bootstrap_interval(_effects(spark, sf), ["g"], ["history"], "effect", 100, "81004")
    return found.select("g", *(r6(c, c) for c in ("mean", "low", "high")), stats.interval_verdict(F.col("low"), F.col("high")).alias("verdict"))


@query(
    """WITH p AS (SELECT event_type AS g, user_id, sum(value) AS s, count(value) AS c FROM events GROUP BY ALL), x AS (SELECT g, s, c, row_number() OVER (PARTITION BY g ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM p),
    t AS (SELECT g, draw, CAST('0x' || substr(md5('35:' || draw || ':' || slot), 1, 8) AS BIGINT) % n AS i FROM (SELECT g, n, draw, unnest(range(n)) AS slot FROM (SELECT g, n, unnest(range(100)) AS draw FROM (SELECT DISTINCT g, n FROM x)))),
    m AS (SELECT t.g, draw, sum(s) / sum(c) AS m FROM t JOIN x ON x.g = t.g AND x.i = t.i GROUP BY ALL), q AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
    SELECT x.g, count(*) AS clusters, CAST(sum(c) AS BIGINT) AS n, round(sum(s) / sum(c), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM x JOIN q ON q.g = x.g GROUP BY 1"""
)
def cluster_bootstrap_portable(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value by type with an interval over users, who have different numbers of events."""
    found = resample.cluster_interval(table(spark, sf, "events").select(F.col("event_type").alias("g"), "user_id", "value"), ["g"], "user_id", "value", 100, "35")
    return found.select("g", "clusters", "n", *(r6(c, c) for c in ("mean", "low", "high")))


_RATIO = _DRAWS.replace("effect, row_number", "score, member, row_number").replace("FROM family_pairs WHERE effect IS NOT NULL", "FROM families WHERE member = 1")


@query(
    f"WITH {_RATIO.format(draws=60, seed='73021')}, m AS (SELECT t.g, draw, avg(score) / avg(score + history) AS r, avg(score + history) AS b FROM t JOIN x ON x.g = t.g AND x.i = t.i GROUP BY ALL) SELECT m.g, round(any_value(o), 6) AS ratio, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, quantile_cont(b, 0.025) > 1 AND min(b) > 1 AS usable FROM m JOIN (SELECT g, avg(score) / avg(score + history) AS o FROM x GROUP BY 1) y ON y.g = m.g GROUP BY 1",
    uses="families",
)
def bootstrap_ratio_portable(spark: SparkSession, sf: str) -> DataFrame:
    rows = families(spark, sf).filter("member = 1").withColumnRenamed("family", "g").withColumn("base", F.col("score") + F.col("history"))
    found = resample.ratio_interval(rows, ["g"], ["history"], "score", "base", 60, "73021")
    return found.select("g", *(r6(c, c) for c in ("ratio", "low", "high")), "usable")


@query(
    """WITH x AS (SELECT family AS g, history, effect, row_number() OVER (PARTITION BY family ORDER BY history) - 1 AS i FROM family_pairs WHERE effect IS NOT NULL), d AS (SELECT g, effect, i, unnest(range(100)) AS draw FROM x),
    m AS (SELECT g, draw, round(avg(effect * CASE WHEN CAST('0x' || substr(md5('flip:' || draw || ':' || i), 1, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END), 9) AS m FROM d GROUP BY ALL), o AS (SELECT g, round(avg(effect), 9) AS o FROM x GROUP BY 1)
    SELECT m.g, round(any_value(o), 6) AS observed, round((count(*) FILTER (abs(m) >= abs(o)) + 1) / 101.0, 6) AS p FROM m JOIN o ON o.g = m.g GROUP BY 1""",
    uses="families family_pairs",
)
def signflip_portable(spark: SparkSession, sf: str) -> DataFrame:
    return resample.sign_flip(_effects(spark, sf), ["g"], ["history"], "effect", 100).select("g", r6("observed", "observed"), r6("p", "p"))


@query(
    f"WITH {_DRAWS.format(draws=100, seed='two')}, m AS (SELECT t.g, draw, avg(effect) AS m FROM t JOIN x ON x.g = t.g AND x.i = t.i GROUP BY ALL), e AS (SELECT draw, max(CASE WHEN g = 'click' THEN m END) - max(CASE WHEN g = 'view' THEN m END) AS d FROM m GROUP BY 1) SELECT round((SELECT avg(effect) FROM x WHERE g = 'click') - (SELECT avg(effect) FROM x WHERE g = 'view'), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM e",
    uses="families family_pairs",
)
def two_sample_diff_portable(spark: SparkSession, sf: str) -> DataFrame:
    two = _effects(spark, sf).filter(F.col("g").isin("click", "view"))
    return resample.two_sample_interval(two, "g", ("click", "view"), ["history"], "effect", 100, "two").select(*(r6(c, c) for c in ("difference", "low", "high")))


@query()
def bootstrap_mean_exact(spark: SparkSession, sf: str) -> DataFrame:
    return streams.exact_intervals(_effects(spark, sf), ["g"], ["history"], "effect", 2000, 81004, 0.975)


@query()
def summary_exact(spark: SparkSession, sf: str) -> DataFrame:
    return streams.exact_summaries(pairs(spark, sf).filter("effect is not null"), ["condition"], ["history"], "effect")


# ---- prediction


@query(
    """WITH p AS (SELECT quality AS y, (doc_id % 97 + 1) / 99.0 AS p FROM labels), c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1),
    r AS (SELECT pos * (coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS w, pos, neg FROM c)
    SELECT (SELECT count(*) FROM p) AS n, round((SELECT sum(w) / (sum(pos) * sum(neg)) FROM r), 6) AS auroc, round((SELECT avg((p - y) * (p - y)) FROM p), 6) AS brier, round((SELECT avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FROM p), 6) AS log_loss"""
)
def auroc_brier_logloss(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 97 + 1) / F.lit(99.0)).alias("p"))
    return predict.metrics(p, "y", "p").select("n", *(r6(c, c) for c in ("auroc", "brier", "log_loss")))


@query()
def grouped_cv(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.log1p("n_chars").alias("size"), *((F.col("lang") == x).cast("double").alias(x) for x in ("de", "es", "fr")))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return predict.cross_validated(rows.join(predict.grouped_folds(rows, "source", 5), "source"), ["size", "de", "es", "fr"], "quality", "fold", ["doc_id", "source"])


@query(
    """WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('split:' || source), source) AS r, count(*) OVER () AS n FROM g)
    SELECT split, count(*) AS docs FROM (SELECT CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.85, 0) THEN 'validation' ELSE 'test' END AS split, source FROM r) JOIN documents USING (source) GROUP BY 1"""
)
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    found = design.split_groups(table(spark, sf, "documents").select("source", "doc_id"), "source", [("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split")
    return found.groupBy("split").agg(F.count("*").alias("docs"))
