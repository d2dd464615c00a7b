"""Pair effects: baseline (member 0) against edited (member 1) records.

A pair is built by one aggregation on its key, not by a self-join: one shuffle, no fan-out. Histories that lack a member give null
effects, which aggregates ignore; use `checks.complete` first where a missing member must raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import js_divergence, softmax


def paired(df: DataFrame, keys: Sequence[str], member: str, values: Sequence[str]) -> DataFrame:
    """One row per key with value_0 and value_1 of each value column, and n_members."""
    side = lambda v, m: F.any_value(F.when(F.col(member) == m, F.col(v)), True).alias(f"{v}_{m}")
    return df.groupBy(*keys).agg(F.count("*").alias("n_members"), *(side(v, m) for v in values for m in (0, 1)))


def identity_transfer(baseline: Column, edited: Column, source: Column, replacement: Column) -> dict[str, Column]:
    """E = (L_e[r] - L_e[s]) - (L_b[r] - L_b[s]) over score maps, with its two components; E = replacement less source change."""
    at = lambda m, k: F.element_at(m, k)
    replaced, sourced = at(edited, replacement) - at(baseline, replacement), at(edited, source) - at(baseline, source)
    return {"effect": (at(edited, replacement) - at(edited, source)) - (at(baseline, replacement) - at(baseline, source)), "replacement_change": replaced, "source_change": sourced}


def decision_shift(baseline: Column, edited: Column, wrong: Column, correct: Column) -> Column:
    """D: the wrong action's gain over the correct one, both named by member 0 even where the edit flips the truth.

    Signed so that a member-0 record that leans to the wrong action gives a positive shift.
    """
    lean = lambda m: F.element_at(m, wrong) - F.element_at(m, correct)
    return lean(baseline) - lean(edited)


def net_switch(wrong_0: Column, wrong_1: Column) -> Column:
    """1, 0 or -1: wrong at member 0 but not 1, no change, the reverse. Invalid answers are not wrong."""
    return wrong_0.cast("int") - wrong_1.cast("int")


def codebook_transfer(baseline: Column, edited: Column, codebook: Column, source: Column, replacement: Column) -> Column:
    """Identity transfer on the codes of two values."""
    return identity_transfer(baseline, edited, F.element_at(codebook, source), F.element_at(codebook, replacement))["effect"]


def margin_change(correct_0: Column, stale_0: Column, correct_1: Column, stale_1: Column, has_stale: Column) -> Column:
    """Change of the correct-minus-stale margin; null where there is no stale value (the pair still counts)."""
    return F.when(has_stale, (correct_1 - stale_1) - (correct_0 - stale_0))


def toward_donor(delta: Column, donor: Column, baseline_donor: str) -> Column:
    """A patch delta signed towards its donor."""
    return F.when(donor == baseline_donor, -delta).otherwise(delta)


def normalized_recovery(patched: Column, clean: Column, corrupt: Column, least: float = 1e-6) -> Column:
    """(patched - corrupt) / (clean - corrupt); null where the denominator is within `least` of 0."""
    gap = clean - corrupt
    return F.when(F.abs(gap) > least, (patched - corrupt) / gap)


def generation_did(edited: Column, baseline: Column, source: Column, replacement: Column) -> Column:
    """((e = r) - (b = r)) - ((e = s) - (b = s)) over generated answers."""
    hit = lambda x, v: (x == v).cast("int")
    return (hit(edited, replacement) - hit(baseline, replacement)) - (hit(edited, source) - hit(baseline, source))


def mean_of_directions(df: DataFrame, keys: Sequence[str], direction: str, value: str) -> DataFrame:
    """Mean over rows within a direction, then over the two directions; null unless both are there."""
    inner = df.groupBy(*keys, direction).agg(F.avg(value).alias("__x"))
    return inner.groupBy(*keys).agg(F.when(F.count("__x") == 2, F.avg("__x")).alias(value))


def local_relevance(baseline: Column, edited: Column, baseline_other: Column, edited_other: Column, source: Column, replacement: Column) -> Column:
    """R_easy_local: the edit's identity transfer on the easy question about its own entity, less that on the other entity's."""
    return identity_transfer(baseline, edited, source, replacement)["effect"] - identity_transfer(baseline_other, edited_other, source, replacement)["effect"]


def accuracy_delta(correct_0: Column, correct_1: Column) -> Column:
    """1, 0 or -1: right at member 0 but not 1, no change, the reverse."""
    return correct_0.cast("int") - correct_1.cast("int")


def fixed_competitor_margin(baseline: Column, edited: Column, answer: Column) -> dict[str, Column]:
    """Decision margins of arrays of scores: each against its own strongest competitor, and the edited one against the baseline's (first on ties)."""
    others = lambda v: F.transform(v, lambda x, i: F.when(i != answer, x))
    best = lambda v: F.array_max(F.filter(others(v), lambda x: x.isNotNull()))
    first = F.array_position(others(baseline), best(baseline)).cast("int") - 1
    at = F.get(edited, answer)
    return {"margin_before": F.get(baseline, answer) - best(baseline), "margin_after": at - best(edited), "margin_fixed": at - F.get(edited, first)}


def js_change(baseline: Column, edited: Column, first: Column, second: Column) -> dict[str, Column]:
    """Divergence between two score arrays' distributions, and the changes of two of their probabilities (0-based places)."""
    p, q = softmax(baseline), softmax(edited)
    return {"js": js_divergence(p, q), "delta_first": F.get(q, first) - F.get(p, first), "delta_second": F.get(q, second) - F.get(p, second)}
