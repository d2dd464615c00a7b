"""The flagship: from raw scores to a contrast with its interval, fail-closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import checks, contrasts, resample
from ..operators.pinning import pinned
from .base import cells, pairs, query, r6

DRAWS = 100


@query(
    f"""WITH w AS (SELECT history, max(CASE WHEN condition = 'A' THEN effect END) - max(CASE WHEN condition = 'R' THEN effect END) AS a_minus_r, max(CASE WHEN condition = 'N' THEN effect END) - max(CASE WHEN condition = 'R' THEN effect END) AS n_minus_r FROM pairs GROUP BY 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY history) - 1 AS i, count(*) OVER (PARTITION BY contrast) AS n FROM (SELECT history, 'a_minus_r' AS contrast, a_minus_r AS v FROM w UNION ALL SELECT history, 'n_minus_r', n_minus_r FROM w) WHERE v IS NOT NULL),
    s AS (SELECT contrast, n, draw, unnest(range(n)) AS slot FROM (SELECT contrast, n, unnest(range({DRAWS})) AS draw FROM (SELECT DISTINCT contrast, n FROM x))),
    m AS (SELECT s.contrast, draw, avg(v) AS m FROM s JOIN x ON x.contrast = s.contrast AND x.i = CAST('0x' || substr(md5('81004:' || draw || ':' || slot), 1, 8) AS BIGINT) % s.n GROUP BY ALL),
    q AS (SELECT contrast, quantile_cont(m, 0.0125) AS low, quantile_cont(m, 0.9875) AS high FROM m GROUP BY 1)
    SELECT contrast, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CAST(v > 0 AS DOUBLE)), 6) AS fraction_positive, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high,
    CASE WHEN any_value(low) > 0 THEN 'positive' WHEN any_value(high) < 0 THEN 'negative' ELSE 'includes_zero' END AS verdict FROM x JOIN q USING (contrast) GROUP BY 1""",
    uses="cells pairs",
)
def condition_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Contrasts of conditions per supplier, summarised with a 97.5 % portable bootstrap interval."""
    wide = contrasts.pivot_cells(pairs(spark, sf), ["history"], "condition", {"a": "A", "n": "N", "r": "R"}, "effect")
    both = wide.select("history", (F.col("a") - F.col("r")).alias("a_minus_r"), (F.col("n") - F.col("r")).alias("n_minus_r"))
    long = pinned(both.unpivot("history", ["a_minus_r", "n_minus_r"], "contrast", "v").filter("v is not null"))
    ends = resample.bootstrap_interval(long, ["contrast"], ["history"], "v", DRAWS, "81004", 0.975).drop("mean")
    v = F.col("v")
    facts = long.groupBy("contrast").agg(F.count("*").alias("n"), r6(F.avg(v), "mean"), r6(F.median(v), "median"), r6(stats.fraction_positive(v), "fraction_positive"))
    return facts.join(ends, "contrast").select("contrast", "n", "mean", "median", "fraction_positive", r6("low", "low"), r6("high", "high"), stats.interval_verdict(F.col("low"), F.col("high")).alias("verdict"))


def validated_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """condition_contrasts behind its checks: unique and complete cells, finite scores; any violation raises."""
    rows = cells(spark, sf)
    checks.enforce([checks.not_empty(rows), *checks.complete(rows, "history", ["condition", "member"]), checks.rule(rows, "finite_score", ~F.isnan("score"))])
    return condition_contrasts(spark, sf)
