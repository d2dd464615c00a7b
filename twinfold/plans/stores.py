"""Files written and read again, canonical digests, checksums and seals, reports and the scorer boundary on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, scores
from ..operators import contrasts, design, gates, lineage
from ..operators.pinning import scratch_folder
from ..sources import records
from ..streaming.append import digest_scorer, score_with
from .base import query, r6, table

c, lit = F.col, F.lit


# ---- files


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as JSON lines, as many files as the table has partitions, and back."""
    path = scratch_folder(spark)
    records.write_jsonl(table(spark, sf, "documents"), path)
    back = records.read_jsonl(spark, path, "doc_id long, lang string, n_chars long, source string, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with a header, read by the path's ending; doubles come back as they were."""
    path, names = scratch_folder(spark) + ".csv", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    records.write_csv(table(spark, sf, "orders").select(*names), path)
    return records.read_by_suffix(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")


@query(
    r"""WITH s AS (SELECT o_orderpriority AS priority, count(*) AS orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY priority) AS i, * FROM s)
    SELECT 0 AS line, '| priority | orders | mean_price |' AS markdown, 'priority & orders & mean\_price \\' AS latex UNION ALL SELECT 1, '|---|---|---|', '\midrule'
    UNION ALL SELECT i + 1, '| ' || priority || ' | ' || orders || ' | ' || printf('%.3f', mean_price) || ' |', priority || ' & ' || orders || ' & ' || printf('%.3f', mean_price) || ' \\' FROM n"""
)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A summary as Markdown and LaTeX lines: a row for each priority, of which a protocol has a few."""
    summary = table(spark, sf, "orders").groupBy(c("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price")).orderBy("priority")
    lines = zip(records.to_markdown(summary).split("\n"), records.to_latex(summary).split("\n"), strict=True)
    return spark.createDataFrame([(i, m, x) for i, (m, x) in enumerate(lines)], "line long, markdown string, latex string")


# ---- digests


def _json(column: str) -> str:
    """SQL of a text column as an ASCII JSON string."""
    unit = "'\\u' || printf('%04x', {})"
    code = "unicode(x)"
    pair = unit.format(f"55296 + ({code} - 65536) // 1024") + " || " + unit.format(f"56320 + ({code} - 65536) % 1024")
    short = " ".join(f"WHEN {n} THEN '\\{x}'" for n, x in ((34, '"'), (92, "\\"), (10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")))
    one = f"CASE {code} {short} ELSE CASE WHEN {code} BETWEEN 32 AND 126 THEN x WHEN {code} < 65536 THEN {unit.format(code)} ELSE {pair} END END"
    return f"""coalesce('"' || list_aggregate(list_prepend('', list_transform(regexp_extract_all({column}, '(?s).'), lambda x: {one})), 'string_agg', '') || '"', 'null')"""


@query(f"""SELECT doc_id, sha256('{{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"lang":' || {_json("lang")} || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":' || {_json("source")} || ',"text":' || {_json("text")} || '}}') AS sha256 FROM documents""")
def canonical_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical digests of whole documents, inside the JVM."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", digests.canonical_digest(docs, ["doc_id", "lang", "n_chars", "source", "text"]).alias("sha256"))


def _hashed(column: str, text: bool) -> str:
    """SQL of a column's part of a row's checksum."""
    value = f"""'{{"{column}":"' || {column} || '"}}'""" if text else f"""'{{"{column}":' || {column} || '}}'"""
    return f"length({value}) || ':' || {value} || ';'"


_CHECKSUM = f"sha256({_hashed('o_custkey', False)} || {_hashed('o_orderkey', False)} || {_hashed('o_orderpriority', True)} || {_hashed('o_orderstatus', True)})"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(f"SELECT o_orderkey, {_CHECKSUM} AS record_sha256 FROM orders")
def record_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.with_checksum(_orders(spark, sf)).select("o_orderkey", "record_sha256")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 7 = 0 AND o_orderstatus <> 'F') OR o_orderkey % 11 = 0")
def checksum_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose status was changed after their checksum was taken (a seventh, if it wasn't so already), or whose checksum is gone (an eleventh)."""
    changed = F.when(c("o_orderkey") % 7 == 0, "F").otherwise(c("o_orderstatus"))
    stored = lineage.with_checksum(_orders(spark, sf)).withColumn("o_orderstatus", changed).withColumn("record_sha256", F.when(c("o_orderkey") % 11 != 0, c("record_sha256")))
    return lineage.bad_checksums(stored).select("o_orderkey")


_ROW_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'"""
_PART = "sum(('0x' || substr(h, {}, 8))::UBIGINT)::VARCHAR"


@query(
    f"""WITH j AS (SELECT o_orderkey, {_ROW_JSON} AS j FROM orders), h AS (SELECT o_orderkey, sha256(length(j) || ':' || j || ';') AS h FROM j)
    SELECT count(*) AS rows, count(*) = count(DISTINCT o_orderkey) AS "unique", sha256(concat_ws(':', count(*)::VARCHAR, {", ".join(_PART.format(1 + 8 * i) for i in range(4))})) AS seal FROM h"""
)
def table_seal_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A table's seal over columns whose JSON SQL can write as well."""
    return lineage.seal(_orders(spark, sf), ["o_orderkey"])


# ---- scores, maps, edits


_LOGP = "(('0x' || substr(md5(doc_id || ':{}'), 1, 8))::UBIGINT / 4294967296.0)"


@query(f"WITH v AS (SELECT doc_id, {', '.join(_LOGP.format(x) + ' AS ' + x for x in 'abc')} FROM documents) SELECT doc_id, {', '.join(f'round(ln(({x} + 0.01) / (a + b + c + 0.03)), 6) AS {x}' for x in 'abc')} FROM v")
def plugin_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a plug-in scorer: a stand-in that a model would replace."""
    scored = score_with(table(spark, sf, "documents").select("doc_id"), digest_scorer("doc_id", ["a", "b", "c"]), "doc_id long, action_logp map<string,double>")
    return scored.select("doc_id", *(r6(c("action_logp")[x], x) for x in "abc"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, n, array_to_string(list_sort(list(event_type)), ',') AS kinds FROM n GROUP BY ALL")
def inverse_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's map from kinds to counts: the kinds of each count."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").count()
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))  # kinds: a protocol's few
    each = maps.select("user_id", "m", F.explode(F.array_distinct(F.map_values("m"))).alias("n"))
    return each.select("user_id", "n", F.array_join(scores.inverse_map(c("m"), c("n")), ",").alias("kinds"))


@query(
    """WITH r AS (SELECT p_partkey, 'Part ' || p_name || '.' || chr(10) || 'Type ' || p_type || '.' || chr(10) || 'End.' AS a, 'Part ' || CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END || '.' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Kind ' || p_brand || '.' ELSE 'Type ' || p_type || '.' END || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'Stop.' ELSE 'End.' END AS b,
    length('Part ' || p_name || '.') + 1 AS start, length('Type ' || p_type || '.') AS n FROM part)
    SELECT p_partkey, left(a, start) = left(b, start) AND right(a, 5) = right(b, 5) AS inside FROM r"""
)
def edits_inside_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Whether edited prompts differ from their baseline within the second line alone: some are edited before it, some behind it."""
    first = lambda x: F.concat(lit("Part "), x, lit("."))
    second = F.concat(lit("Type "), "p_type", lit("."))
    key = c("p_partkey")
    base, spans = design.render([first(c("p_name")), second, lit("End.")])
    edited, _ = design.render([first(F.when(key % 5 == 0, c("p_brand")).otherwise(c("p_name"))), F.when(key % 2 == 0, F.concat(lit("Kind "), "p_brand", lit("."))).otherwise(second), F.when(key % 3 == 0, "Stop.").otherwise("End.")])
    return table(spark, sf, "part").select("p_partkey", design.differs_only_inside(base, edited, spans[1]).alias("inside"))


# ---- contrasts and gates


@query(
    """WITH e AS (SELECT l_suppkey AS history, l_returnflag AS condition, l_linenumber % 2 AS o, avg(l_quantity) AS m FROM lineitem GROUP BY ALL), a AS (SELECT history, condition, CASE WHEN count(m) = 2 THEN avg(m) END AS m FROM e GROUP BY ALL)
    SELECT history, round(avg(m) FILTER (condition = 'A') - avg(m) FILTER (condition = 'R'), 6) AS difference FROM a GROUP BY 1"""
)
def orders_averaged_first(spark: SparkSession, sf: str) -> DataFrame:
    """A contrast of conditions after two nuisance orders, of unequal numbers of rows, are averaged within each history."""
    items = table(spark, sf, "lineitem").select(c("l_suppkey").alias("history"), c("l_returnflag").alias("condition"), (c("l_linenumber") % 2).alias("place"), "l_quantity")
    even = contrasts.averaged_orders(items, ["history", "condition"], ["place"], 2, "l_quantity")
    wide = contrasts.pivot_cells(even, ["history"], "condition", {"a": "A", "r": "R"}, "l_quantity")
    return wide.select("history", r6(c("a") - c("r"), "difference"))


@query(
    """WITH r AS (SELECT CAST(l_linenumber % 5 AS INTEGER) AS variant, l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_linenumber % 5 = 1 AND l_quantity > 49 THEN 0 ELSE 1 END AS ok, CASE WHEN l_linenumber % 5 = 2 AND l_discount > 0.09 THEN 2 ELSE 1 END AS place, l_linenumber % 5 <> 3 OR l_quantity > 1 AS aligned FROM lineitem WHERE l_linenumber % 5 <> 4 OR l_returnflag <> 'N' OR l_linestatus <> 'F'),
    g AS (SELECT variant, flag, status, avg(ok) = 1 AND max(place) = 1 AS good, bool_and(aligned) AS aligned FROM r GROUP BY ALL), x AS (SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, true AS known FROM lineitem),
    n AS (SELECT variant, count(*) AS cells, (SELECT count(*) FROM x) - count(known) AS missing_cells, count(*) FILTER (known IS NULL) AS unexpected_cells, count(*) FILTER (NOT good) AS failed_cells, bool_and(aligned) AS aligned FROM g LEFT JOIN x USING (flag, status) GROUP BY 1)
    SELECT *, missing_cells = 0 AND unexpected_cells = 0 AND failed_cells = 0 AND aligned AS passes FROM n"""
)
def gate_perfect_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Five variants over cells of flags and states: misses, ranks, unaligned rows and a missing cell are planted in one each; variant 0 passes."""
    items = table(spark, sf, "lineitem").select((c("l_linenumber") % 5).cast("int").alias("variant"), c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"), "l_quantity", "l_discount")
    v = c("variant")
    rows = items.filter((v != 4) | (c("flag") != "N") | (c("status") != "F")).select(
        "variant", "flag", "status", F.when((v == 1) & (c("l_quantity") > 49), 0).otherwise(1).alias("ok"), F.when((v == 2) & (c("l_discount") > 0.09), 2).otherwise(1).alias("place"), ((v != 3) | (c("l_quantity") > 1)).alias("aligned"),
    )
    return gates.perfect_gate(rows, "variant", ["flag", "status"], items.select("flag", "status").distinct(), ["ok"], ["place"], "aligned")
