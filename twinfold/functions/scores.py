"""Scalar functions over score maps and candidate arrays, inside whole-row expressions: no UDF, no shuffle.

A score map is map<string,double>; a candidate array is array<double> in candidate order. Missing keys give null (use
`checks.missing_keys` to fail on them). Ties follow each function's documented rule, never the engine's order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body) -> Column:
    """body over a value that is computed once per row, even inside loops."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def strict_rank(values: Column, target: Column) -> Column:
    """1 + the number of other candidates at or above the target's score (target: 0-based position). Ties lose."""
    own = F.get(values, target)
    return 1 + F.size(F.filter(values, lambda x, i: (i != target) & (x >= own)))


def lenient_rank(values: Column, target: Column) -> Column:
    """1 + the number of candidates above the target's score. Ties share."""
    own = F.get(values, target)
    return 1 + F.size(F.filter(values, lambda x: x > own))


def strict_first(values: Column, target: Column) -> Column:
    """Whether all other candidates score below the target."""
    return strict_rank(values, target) == 1


def argmax_first(values: Column) -> Column:
    """0-based position of the largest value; the first on a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def strongest_other(values: Column, target: Column) -> Column:
    """Position of the best candidate but the target; the first in candidate order on a tie."""
    best = F.array_max(F.transform(F.filter(F.transform(values, lambda x, i: F.struct(x.alias("v"), (-i).alias("minus"))), lambda s: s["minus"] != -target), lambda s: s))
    return -best["minus"]


def competitor_margin(values: Column, target: Column) -> Column:
    """Target's score less the best other one."""
    return F.get(values, target) - F.array_max(F.filter(values, lambda x, i: i != target))


def softmax(values: Column) -> Column:
    """Max-shifted softmax over an array."""
    shifted = let(F.array_max(values), lambda m: F.transform(values, lambda x: F.exp(x - m)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def logsumexp(values: Column) -> Column:
    """log of the sum of exponentials. -inf terms drop out; null if no finite term is left, or if any is NaN or +inf (fail on null)."""
    inf = float("inf")
    bad = F.exists(values, lambda x: F.isnan(x) | (x == inf) | x.isNull())
    finite = F.filter(values, lambda x: x > -inf)
    return F.when(~bad & (F.size(finite) > 0), let(finite, lambda f: let(F.array_max(f), lambda m: m + F.log(total(F.transform(f, lambda x: F.exp(x - m)))))))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence with natural logs and EPS inside the logs only (so disjoint inputs stay just under ln 2)."""
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    part = lambda x, m: total(F.zip_with(x, m, lambda a, b: a * (F.log(a + EPS) - F.log(b + EPS))))
    return let(mid, lambda m: (part(p, m) + part(q, m)) / 2)


def role_contrasts(query_old: Column, distractor_old: Column, query_current: Column, distractor_current: Column) -> dict[str, Column]:
    """Contrasts of four roles' scores: old, current, and the current one's margin over the best other."""
    return {"old_contrast": query_old - distractor_old, "current_contrast": query_current - distractor_current, "margin": query_current - F.greatest(query_old, distractor_old, distractor_current)}


def class_confidence(scores: Column, key: Column) -> Column:
    """exp(score of key) by the sum of exponentials over a score map."""
    return F.exp(F.element_at(scores, key)) / total(F.transform(F.map_values(scores), F.exp))


def mass(scores: Column) -> Column:
    """Probability mass of a map of log probabilities."""
    return total(F.transform(F.map_values(scores), F.exp))


def mass_is_valid(scores: Column, saved: Column, over: float = 1e-6, off: float = 1e-9) -> Column:
    """Whether the mass doesn't exceed 1 and equals the saved one."""
    return let(mass(scores), lambda m: (m <= 1 + over) & (F.abs(saved - m) <= off))


def inverse_map(mapping: Column, value: Column) -> Column:
    """Keys that map to value, sorted."""
    return F.sort_array(F.map_keys(F.map_filter(mapping, lambda k, v: v == value)))


def set_key(mapping: Column, key: Column, value: Column) -> Column:
    """The map with one key's value replaced (or added)."""
    return F.map_concat(F.map_filter(mapping, lambda k, v: k != key), F.create_map(key, value))


def map_entries_sorted(mapping: Column) -> Column:
    """A map as a comparable array (Spark has no equality of maps)."""
    return F.sort_array(F.map_entries(mapping))


def normalized_depth(layer: Column, layers: Column) -> Column:
    """layer of `layers` as a share of the last one; 0 if there is only one."""
    return F.when(layers > 1, layer / (layers - 1).cast("double")).otherwise(0.0)


def semantic_log_mass(surfaces: Column) -> Column:
    """map<value, array<struct<log_probability>>> of surface forms to map<value, log of their summed probability>."""
    return F.transform_values(surfaces, lambda k, events: logsumexp(F.transform(events, lambda e: e["log_probability"])))


def one_hot(column: Column, levels: list) -> list[Column]:
    """0.0 / 1.0 columns for each level but the first; null counts as no level."""
    return [F.coalesce((column == v).cast("double"), F.lit(0.0)) for v in levels[1:]]


def normalized(column: Column, aliases: dict[str, str], default: str) -> Column:
    """Enum values with their aliases replaced, and a default for null."""
    names = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.element_at(names, column), column, F.lit(default))


def axis_of(name: Column) -> Column:
    """The axis that a field's name ends with: current_x is of axis x."""
    return F.right(name, F.lit(1))
