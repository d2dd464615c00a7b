"""Protocol contrasts, lineage, number tracing, probes and token events on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import design, grouping, lineage, predict, probes, protocols
from ..operators import pairs as pair_ops
from .base import candidates, query, r6, table

_W = "w AS (SELECT l_suppkey AS history, l_linenumber % 2 AS h, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS c, l_extendedprice AS v FROM lineitem)"


@query(
    f"""WITH {_W}, e AS (SELECT history, avg(CASE WHEN h = 0 AND c = 0 THEN v END) AS e00, avg(CASE WHEN h = 0 AND c = 1 THEN v END) AS e01, avg(CASE WHEN h = 1 AND c = 0 THEN v END) AS e10, avg(CASE WHEN h = 1 AND c = 1 THEN v END) AS e11 FROM w GROUP BY 1)
    SELECT history, round((e00 + e11) / 2, 4) AS aligned, round((e01 + e10) / 2, 4) AS reversed, round((e00 + e11 - e01 - e10) / 2, 4) AS interaction FROM e"""
)
def order_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("history"), (F.col("l_linenumber") % 2).alias("h"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("c"), F.col("l_extendedprice").alias("v"))
    found = protocols.order_contrasts(rows, ["history"], "h", "c", "v")
    return found.select("history", *(F.round(c, 4).alias(c) for c in ("aligned", "reversed", "interaction")))


_NAMES = {"0": "old_x", "1": "new_x", "2": "old_z", "3": "new_z"}


@query(
    """WITH w AS (SELECT l_suppkey AS history, l_partkey % 4 AS b, l_orderkey % 4 AS q, l_quantity AS v FROM lineitem), e AS (SELECT history, b, q, avg(v) AS v FROM w GROUP BY ALL),
    p AS (SELECT history, max(CASE WHEN b = 0 AND q = 0 THEN v END) - max(CASE WHEN b = 0 AND q = 1 THEN v END) + max(CASE WHEN b = 1 AND q = 1 THEN v END) - max(CASE WHEN b = 1 AND q = 0 THEN v END) AS x,
    max(CASE WHEN b = 2 AND q = 2 THEN v END) - max(CASE WHEN b = 2 AND q = 3 THEN v END) + max(CASE WHEN b = 3 AND q = 3 THEN v END) - max(CASE WHEN b = 3 AND q = 2 THEN v END) AS z FROM e GROUP BY 1)
    SELECT history, round(x / 2, 6) AS selectivity_x, round(z / 2, 6) AS selectivity_z, round((x / 2 + z / 2) / 2, 6) AS selectivity FROM p"""
)
def four_query_selectivity(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("history"), F.element_at(names, (F.col("l_partkey") % 4).cast("string")).alias("b"), F.element_at(names, (F.col("l_orderkey") % 4).cast("string")).alias("q"), F.col("l_quantity").alias("v"))
    found = protocols.version_selectivity(rows, "history", "b", "q", "v")
    return found.select("history", *(r6(c, c) for c in ("selectivity_x", "selectivity_z", "selectivity")))


@query(
    """WITH w AS (SELECT l_suppkey AS history, CASE WHEN l_returnflag = 'A' THEN 'x' ELSE 'z' END AS axis, l_linenumber AS position, CASE WHEN l_linestatus = 'O' THEN 'applied' ELSE 'ignored' END AS s, CASE WHEN l_quantity > 25 THEN 'proposed' ELSE 'initial' END AS f, l_extendedprice AS v FROM lineitem),
    p AS (SELECT history, axis, s, f, avg(v) AS v FROM (SELECT history, axis, s, f, position, avg(v) AS v FROM w GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT history, axis, max(CASE WHEN s = 'applied' AND f = 'proposed' THEN v END) - max(CASE WHEN s = 'ignored' AND f = 'proposed' THEN v END) AS pe, max(CASE WHEN s = 'ignored' AND f = 'initial' THEN v END) - max(CASE WHEN s = 'applied' AND f = 'initial' THEN v END) AS ie FROM p GROUP BY ALL),
    b AS (SELECT history, axis, pe, ie, pe + ie AS ac FROM a UNION ALL SELECT history, 'symmetric', CASE WHEN count(pe) = 2 THEN avg(pe) END, CASE WHEN count(ie) = 2 THEN avg(ie) END, CASE WHEN count(pe + ie) = 2 THEN avg(pe + ie) END FROM a GROUP BY 1)
    SELECT history, axis, round(pe, 4) AS proposed_effect, round(ie, 4) AS initial_effect, round(ac, 4) AS acceptance FROM b"""
)
def focal_validity(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("history"), F.when(c("l_returnflag") == "A", "x").otherwise("z").alias("axis"), c("l_linenumber").alias("position"), F.when(c("l_linestatus") == "O", "applied").otherwise("ignored").alias("s"),
        F.when(c("l_quantity") > 25, "proposed").otherwise("initial").alias("f"), c("l_extendedprice").alias("v"),
    )
    found = protocols.focal_validity(rows, "history", "axis", "position", "s", "f", "v")
    return found.select("history", "axis", *(F.round(x, 4).alias(x) for x in ("proposed_effect", "initial_effect", "acceptance")))


@query(
    """WITH w AS (SELECT l_partkey AS id, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS m, CAST(l_discount > 0.05 AS DOUBLE) AS ok, l_quantity AS margin FROM lineitem)
    SELECT id, round(avg(CASE WHEN m = 0 THEN ok END), 6) AS accuracy_0, round(avg(CASE WHEN m = 1 THEN ok END), 6) AS accuracy_1, round(avg(CASE WHEN m = 1 THEN margin END) - avg(CASE WHEN m = 0 THEN margin END), 6) AS margin_change FROM w GROUP BY 1"""
)
def answer_stability(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("m"), (F.col("l_discount") > 0.05).alias("ok"), F.col("l_quantity").alias("margin"))
    found = protocols.answer_stability(rows, ["id"], "m", "ok", "margin")
    return found.select("id", *(r6(c, c) for c in ("accuracy_0", "accuracy_1", "margin_change")))


@query(
    """SELECT l_suppkey AS history, l_linenumber AS position, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS first, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS second,
    array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS roles FROM lineitem GROUP BY ALL"""
)
def position_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "history", "l_linenumber": "position"})
    return protocols.position_table(rows, ["history"], "position", "l_linestatus", ("F", "O"), "l_returnflag", "l_quantity").select("history", "position", r6("first", "first"), r6("second", "second"), "roles")


@query("SELECT o_orderpriority AS model, round(sum(o_totalprice) / 3600, 4) AS hours FROM orders GROUP BY 1")
def gpu_hours(spark: SparkSession, sf: str) -> DataFrame:
    found = grouping.gpu_hours(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "model"), ["model"], "o_totalprice")
    return found.select("model", F.round("hours", 4).alias("hours"))


@query(
    """WITH s AS (SELECT user_id, event_type AS value, list(ln(value + 1) ORDER BY event_id) AS lps FROM events GROUP BY ALL)
    SELECT user_id, value, round(list_max(lps) + ln(list_sum(list_transform(lps, lambda x: exp(x - list_max(lps))))), 6) AS log_mass FROM s"""
)
def semantic_log_mass(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.collect_list(F.struct(F.log(F.col("value") + 1).alias("log_probability"))).alias("surfaces"))
    maps = events.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "surfaces"))).alias("m"))
    return maps.select("user_id", F.explode(scores.semantic_log_mass(F.col("m"))).alias("value", "mass")).select("user_id", "value", r6("mass", "log_mass"))


@query(
    """WITH n AS (SELECT 'balance.' || c_custkey AS path, c_acctbal AS v FROM customer UNION ALL SELECT 'balance.' || c_custkey, c_acctbal * 100 FROM customer WHERE c_acctbal BETWEEN 0 AND 1),
    l AS (SELECT CAST(s_suppkey * 100 AS VARCHAR) AS text FROM supplier) SELECT l.text, count(DISTINCT n.path) AS n_paths FROM l LEFT JOIN n ON round_even(v, 0) = CAST(l.text AS DOUBLE) GROUP BY 1"""
)
def number_trace(spark: SparkSession, sf: str) -> DataFrame:
    numbers = table(spark, sf, "customer").select(F.concat(F.lit("balance."), "c_custkey").alias("path"), F.col("c_acctbal").alias("value"))
    literals = table(spark, sf, "supplier").select((F.col("s_suppkey") * 100).cast("string").alias("text"))
    return grouping.trace_numbers(numbers, literals).select("text", F.size("paths").cast("long").alias("n_paths"))


@query()
def table_seal(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.seal(table(spark, sf, "orders"), ["o_orderkey"])


@query(
    "SELECT count(*) AS cells, count(*) * 11 AS records, round(count(*) * 11 * 2.67 / 3600, 6) AS hours FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)"
)
def workload_estimate(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    return protocols.workload(cells, 11, 2.67).select("cells", "records", r6("hours", "hours"))


@query("SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL")
def first_cell_sample(spark: SparkSession, sf: str) -> DataFrame:
    return design.first_cell_sample(table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


@query("SELECT least(l_returnflag, l_linestatus) || '|' || greatest(l_returnflag, l_linestatus) AS signature, count(*) AS n FROM lineitem GROUP BY 1")
def orientation_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(design.orientation_key(F.col("l_returnflag"), F.col("l_linestatus")).alias("signature")).agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT l_suppkey AS id, l_linestatus AS d, avg(l_discount) AS x FROM lineitem GROUP BY ALL) SELECT id, round(CASE WHEN count(x) = 2 THEN avg(x) END, 6) AS x FROM w GROUP BY 1"""
)
def mean_of_directions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("d"), F.col("l_discount").alias("x"))
    return pair_ops.mean_of_directions(rows, ["id"], "d", "x").select("id", r6("x", "x"))


@query()
def probe_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Four slices of the embeddings, all of their numbers, as layers; splits by md5 of the id."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", predict.hashed_fold(F.col("vec_id"), 10, "probe").alias("fold"))
    split = F.when(F.col("fold") < 6, "train").when(F.col("fold") < 8, "validation").otherwise("test")
    long = rows.select("vec_id", "label", split.alias("split"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer"), "embedding").withColumn("vector", F.slice("embedding", F.col("layer") * 16 + 1, F.lit(16)))
    return probes.probe_curve(long, "layer", [0, 1, 2, 3], "vector", "label", "split", key="vec_id")


@query("SELECT vec_id, CASE WHEN answer = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_1, CASE WHEN answer = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_2 FROM candidates", uses="candidates")
def one_hot_features(spark: SparkSession, sf: str) -> DataFrame:
    a, b = scores.one_hot(F.col("answer"), [0, 1, 2])
    return candidates(spark, sf).select("vec_id", a.alias("is_1"), b.alias("is_2"))


@query(
    """WITH m AS (SELECT l_linenumber AS layer, l_suppkey AS history, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT layer, round(avg(v), 6) AS mean, count(*) AS histories FROM m GROUP BY 1"""
)
def layer_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("layer"), F.col("l_suppkey").alias("history"), F.col("l_quantity").alias("v"))
    return grouping.two_level_mean(rows, ["layer"], "history", "v").select("layer", r6("v", "mean"), "histories")

