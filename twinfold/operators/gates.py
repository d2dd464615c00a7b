"""Competence gates: decisions per cell and overall, always computed from rows and never from a stored flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import Check, constant, enforce, forbidden_columns, not_empty, rule
from .grouping import distinct_prompts


def cell_gate(cells: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """cells with a boolean for each rule (null counts as failed), `passes` (all of them) and `failed` (names, in order)."""
    ok = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    failed = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in ok.items())), lambda x: x.isNotNull())
    return cells.select("*", *(c.alias(n) for n, c in ok.items())).withColumn("passes", F.expr(" and ".join(f"`{n}`" for n in ok))).withColumn("failed", failed)


def overall(gated: DataFrame, any_cell: bool = False) -> DataFrame:
    """One row: cells, passing cells, and the decision (all cells, or any)."""
    decide = F.bool_or("passes") if any_cell else F.bool_and("passes")
    return gated.agg(F.count("*").alias("cells"), F.count_if(F.col("passes")).alias("passing"), F.coalesce(decide, F.lit(False)).alias("passes"))


def decision_rules(direct: str = "direct", current: str = "current_only", invalid: str = "invalid", easy_invalid: str = "easy_invalid") -> dict[str, Column]:
    """The decision protocol's thresholds."""
    return {"direct_ok": F.col(direct) >= 0.95, "current_ok": F.col(current) >= 0.90, "invalid_ok": F.col(invalid) <= 0.05, "easy_invalid_ok": F.col(easy_invalid) <= 0.05}


def behavior_rules(historical: str = "historical", **columns: str) -> dict[str, Column]:
    """The decision thresholds, with historical accuracy neither at floor nor at ceiling."""
    return decision_rules(**columns) | {"historical_ok": F.col(historical).between(0.65, 0.95)}


def natural_rules() -> dict[str, Column]:
    """Full-vocabulary and candidate accuracy, mean rank, and margin over the stale value, which decides only where there is such a value."""
    return {"full_ok": F.col("full_vocab_accuracy") >= 0.99, "candidate_ok": F.col("candidate_accuracy") >= 0.99, "rank_ok": F.col("mean_rank") <= 1.01, "margin_ok": F.col("stale_margin").isNull() | (F.col("stale_margin") > 0)}


def natural_gate(rows: DataFrame, cell: Sequence[str], expected: DataFrame, signature: Sequence[str], full: str = "full", right: str = "right", rank: str = "rank", margin: str = "margin", target_rank: str | None = None, parsed: str | None = None, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per cell: its unique prompts, accuracies, ranks, parse rate and stale margin, the rules, `passes` and `failed`.

    A prompt (signature) counts once in each cell that has it, and its diagnostics must agree over all its rows. The cells must be those of
    `expected`, no more and no fewer. Accuracies must be 0 or 1, ranks 1 or more, and numbers finite. margin (over the stale value),
    target_rank and parsed may be null: then they don't count. What is violated raises with its number of cases.
    """
    more = [x for x in (target_rank, parsed) if x]
    diagnostics = [full, right, rank, margin, *more]
    numbers = [F.col(x).cast("double") for x in diagnostics]
    there = rows.select(*cell).distinct()
    zero_one = lambda x: F.col(x).cast("double").isin(0.0, 1.0)
    ranks = F.col(rank) >= 1 if not target_rank else (F.col(rank) >= 1) & (F.col(target_rank).isNull() | (F.col(target_rank) >= 1))
    on = lambda a, b: [a[c].eqNullSafe(b[c]) for c in cell]
    enforce([
        not_empty(rows), rule(rows, "accuracy_or_rank", zero_one(full) & zero_one(right) & ranks),
        rule(rows, "finite", ~F.exists(F.array(*numbers), lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)))),
        constant(rows, signature, diagnostics), Check("missing_cells", expected.join(there, on(expected, there), "left_anti")), Check("unexpected_cells", there.join(expected, on(there, expected), "left_anti")),
    ])
    unique = distinct_prompts(rows, [*cell, *signature], diagnostics)
    mean = lambda x: F.avg(F.col(x).cast("double"))
    some = [mean(target_rank).alias("mean_target_rank"), F.max(target_rank).alias("max_target_rank")] if target_rank else []
    some += [mean(parsed).alias("parse_rate")] if parsed else []
    cells = unique.groupBy(*cell).agg(F.count("*").alias("prompts"), mean(full).alias("full_vocab_accuracy"), mean(right).alias("candidate_accuracy"), mean(rank).alias("mean_rank"), mean(margin).alias("stale_margin"), *some)
    return cell_gate(cells, rules or natural_rules())


def prefix_gate(cells: DataFrame, keys: Sequence[str], depth: str, passes: str = "passes") -> DataFrame:
    """A depth is open only if it and all smaller ones pass."""
    by = Window.partitionBy(*keys).orderBy(depth).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("open", F.bool_and(passes).over(by))


def least_count(n: Column, threshold: float) -> Column:
    """Successes out of n that a threshold asks for, rounded up (1e-9 forgives binary fractions)."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def pick_difficulty(cells: DataFrame, difficulty: str, accuracy: str, low: float = 0.65, high: float = 0.90, aim: float = 0.775) -> DataFrame:
    """The hardest difficulty with an accuracy in the window; if none is, the one nearest to `aim` (the easier on a tie)."""
    inside = F.col(accuracy).between(low, high)
    ranked = cells.select(difficulty, accuracy, inside.alias("__in"), F.when(inside, -F.col(difficulty)).otherwise(F.col(difficulty)).alias("__d"), F.when(inside, 0.0).otherwise(F.abs(F.col(accuracy) - aim)).alias("__off"))
    return ranked.orderBy(F.col("__in").desc(), "__off", "__d").limit(1).select(difficulty, accuracy, F.col("__in").alias("in_window"))


def shallowest_in_window(cells: DataFrame, depth: str, accuracy: str, low: float, high: float) -> DataFrame:
    """The smallest depth at which any row's accuracy is in the window."""
    return cells.filter(F.col(accuracy).between(low, high)).agg(F.min(depth).alias(depth))


def perfect_gate(rows: DataFrame, variant: str, cell: Sequence[str], expected: DataFrame, accuracies: Sequence[str], ranks: Sequence[str], aligned: str, least: float = 1.0) -> DataFrame:
    """One row per variant: cells, missing_cells, unexpected_cells, failed_cells, aligned and passes.

    A variant passes if its cells are those of `expected` (a protocol's design), each one's accuracies reach `least` with no rank but 1, and all
    its rows have aligned tokens. A cell with a null accuracy or rank among its rows fails, and a row of unknown alignment isn't aligned.
    Accuracies must be 0 or 1 and ranks 1 or more: what isn't raises.
    """
    enforce([
        not_empty(rows), *(rule(rows, f"{a}_is_0_or_1", F.col(a).isNull() | F.col(a).cast("double").isin(0.0, 1.0)) for a in accuracies),
        *(rule(rows, f"{r}_from_1", F.col(r).isNull() | (F.col(r) >= 1)) for r in ranks),
    ])
    mean = lambda a: F.avg(F.coalesce(F.col(a).cast("double"), F.lit(0.0)))
    good = reduce(lambda a, b: a & b, [*(mean(a) >= least for a in accuracies), *(F.bool_and(F.coalesce(F.col(r) == 1, F.lit(False))) for r in ranks)])
    found = rows.groupBy(variant, *cell).agg(good.alias("__good"), F.bool_and(F.coalesce(F.col(aligned), F.lit(False))).alias("__aligned"))
    design = expected.select(*(F.col(c).alias(f"__{c}") for c in cell)).distinct().withColumn("__known", F.lit(True))
    n = design.count()
    known = found.join(F.broadcast(design), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell], "left").groupBy(variant)
    cells = known.agg(
        F.count("*").alias("cells"), (n - F.count("__known")).alias("missing_cells"), F.count_if(F.col("__known").isNull()).alias("unexpected_cells"),
        F.count_if(~F.col("__good")).alias("failed_cells"), F.bool_and("__aligned").alias("aligned"),
    )
    return cells.withColumn("passes", F.expr("missing_cells = 0 and unexpected_cells = 0 and failed_cells = 0 and aligned"))


def preferred(cells: DataFrame, variant: str, passes: str, order: Sequence[str]) -> DataFrame:
    """The first variant in the stated order that passes."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(variant))
    return cells.filter(F.col(passes) & (place > 0)).orderBy(place).limit(1).select(variant)


def next_step(plan: DataFrame, step: str = "id", status: str = "status", deps: str = "deps", order: str = "ord") -> DataFrame:
    """The first `todo` step whose dependencies are all done (unknown ones block)."""
    needs = plan.filter(F.col(status) == "todo").select(step, order, F.explode_outer(deps).alias("need"))
    done = plan.filter(F.col(status) == "done").select(F.col(step).alias("need"), F.lit(True).alias("ok"))
    ready = needs.join(done, "need", "left").groupBy(step, order).agg(F.bool_and(F.col("need").isNull() | F.coalesce("ok", F.lit(False))).alias("ready"))
    return ready.filter("ready").orderBy(order, step).limit(1).select(step)


def semantic_gate(prompts: DataFrame, condition: str, signature: Sequence[str], correct: str, margin: str, conditions: Sequence[str], margin_conditions: Sequence[str] | None = None, least: float = 0.99) -> DataFrame:
    """Each condition's accuracy and mean margin over unique prompts, and whether it passes: accuracy of at least `least`, margin above 0.

    A prompt whose diagnostics differ between its rows raises. margin_conditions: where the margin decides; everywhere that it exists, if
    not given. Conditions outside `conditions` are left out; those without a prompt fail.
    """
    unique = distinct_prompts(prompts.filter(F.col(condition).isin(*conditions)), [condition, *signature], [correct, margin])
    cells = unique.groupBy(condition).agg(F.count("*").alias("prompts"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(margin).alias("margin"))
    asked = prompts.sparkSession.createDataFrame([(c,) for c in conditions], f"{condition} string")
    decides = F.lit(True) if margin_conditions is None else F.col(condition).isin(*margin_conditions)
    return cell_gate(asked.join(cells, condition, "left"), {"accuracy_ok": F.col("accuracy") >= least, "margin_ok": F.when(decides & F.col("margin").isNotNull(), F.col("margin") > 0).otherwise(True)})


def deep_chain_gate(cells: DataFrame, depth: str, accuracies: Sequence[str], least: float = 0.98, per_depth: int = 8, extra: int = 3) -> DataFrame:
    """Each depth by itself: it has per_depth * (depth + extra) cells, and all of them reach every accuracy."""
    worst = [F.min(a).alias(a) for a in accuracies]
    found = cells.groupBy(depth).agg(F.count("*").alias("cells"), *worst)
    return cell_gate(found, {"cells_ok": F.col("cells") == per_depth * (F.col(depth) + extra)} | {f"{a}_ok": F.col(a) >= least for a in accuracies})


def task_gate(rows: DataFrame, task: str, accuracy: str, tasks: Sequence[str], least: float = 0.97, forbidden: Sequence[str] = ()) -> DataFrame:
    """Each task's pooled accuracy and decision; a task without rows fails. Rows that carry causal fields raise."""
    forbidden_columns(rows, forbidden)
    asked = rows.sparkSession.createDataFrame([(t,) for t in tasks], f"{task} string")
    found = rows.groupBy(task).agg(F.count("*").alias("n"), F.avg(F.col(accuracy).cast("double")).alias("accuracy"))
    return cell_gate(asked.join(found, task, "left"), {"accuracy_ok": F.col("accuracy") >= least})


def pair_of_thresholds(rows: DataFrame, kind: str, kinds: tuple[str, str], accuracy: str, least: tuple[float, float]) -> DataFrame:
    """One row: the accuracies of two kinds of rows (direct and overwrite) and whether each reaches its threshold."""
    mean = lambda k: F.avg(F.when(F.col(kind) == k, F.col(accuracy).cast("double")))
    found = rows.agg(*(mean(k).alias(f"{k}_accuracy") for k in kinds))
    return cell_gate(found, {f"{k}_ok": F.col(f"{k}_accuracy") >= t for k, t in zip(kinds, least, strict=True)})
