"""Audits of a tokenizer before anything is scored: surface events, collisions, prefixes and spans.

The tokenizer is a function from texts to lists of ids, called in bulk inside tasks; what it gives is checked by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks
from .joins import proper_prefixes
from .pinning import pinned

Encode = Callable[[list[str]], list[list[int]]]
PROMPTS = 20_000  # prompts of a task, about
TEXTS, LETTERS = 256, 1 << 20  # texts and their letters that are encoded at once, at most (but one text)


def utf8_bytes(texts: list[str]) -> list[list[int]]:
    """The plainest tokenizer: a text's bytes."""
    return [list(t.encode()) for t in texts]


def encoded(df: DataFrame, text: str, encode: Encode, name: str = "ids") -> DataFrame:
    """df with the token ids of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            found, part, letters = [], [], 0  # lists of Python's numbers are made for a few texts at a time
            for t in b.fillna(""):
                if part and (len(part) >= TEXTS or letters + len(t) > LETTERS):
                    found += (np.array(ids, np.int32) for ids in encode(part))
                    part, letters = [], 0
                part.append(t)
                letters += len(t)
            found += (np.array(ids, np.int32) for ids in encode(part)) if part else ()
            yield pd.Series(found, dtype=object)

    udf = F.pandas_udf(run, "array<int>")
    return df.withColumn(name, udf(F.col(text)))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df dealt to tasks of about so many rows, which are counted first: a table of few files has few tasks, and their Python full batches."""
    return df.repartition(1 + df.count() // rows)


def surfaces(value: Column) -> Column:
    """A value's written forms, spaced ones first: (text, whether it must keep the prompt's tokens)."""
    title = F.initcap(value)
    forms = [(F.concat(F.lit(" "), value), True), (F.concat(F.lit(" "), title), True), (value, False), (title, False)]
    return F.array(*(F.struct(F.lit(i).alias("form"), t.alias("surface"), F.lit(r).alias("required")) for i, (t, r) in enumerate(forms)))


def surface_events(df: DataFrame, key: str, prompt: str, values: Sequence[str], encode: Encode) -> DataFrame:
    """key, value, ids, surface_strings: the token continuations that a prompt's candidate values have, each with the forms that share it.

    A form counts only if the prompt's own tokens stay as they are; a spaced form that changes them raises, and so do two values that share
    a continuation.
    """
    whole = encoded(spread(df.select(key, prompt), PROMPTS), prompt, encode, "__prefix")  # a prompt's own tokens are made once
    values_ = F.explode(F.array(*map(F.lit, values)))
    forms = whole.select(key, prompt, "__prefix", values_.alias("value")).withColumn("s", F.explode(surfaces(F.col("value")))).select(key, prompt, "__prefix", "value", "s.*")
    both = encoded(forms.withColumn("__full", F.concat(prompt, "surface")), "__full", encode, "__all")
    n = F.size("__prefix")
    kept = (F.slice("__all", F.lit(1), n) == F.col("__prefix")) & (F.size("__all") > n)
    marked = both.select(key, "value", "form", "surface", "required", kept.alias("kept"), F.slice("__all", n + 1, F.greatest(F.lit(0), F.size("__all") - n)).alias("ids"))
    marked = pinned(marked)
    good = marked.filter("kept")
    shared = good.groupBy(key, "ids").agg(F.count_distinct("value").alias("n")).filter("n > 1")
    checks.enforce([checks.Check("retokenized_prefix", marked.filter("required and not kept")), checks.Check("collision", shared)])
    strings = F.transform(F.array_sort(F.collect_list(F.struct("form", "surface"))), lambda x: x["surface"])
    return good.groupBy(key, "value", "ids").agg(strings.alias("surface_strings"))


def prefix_conflicts(events: DataFrame, key: str) -> DataFrame:
    """(shorter, longer): continuations of one prompt of which one is a proper prefix of the other; their probabilities would count twice."""
    named = events.select(F.col(key).alias("__of"), F.struct(key, "ids").alias("event"), F.concat(F.array(F.lit(0)), "ids").alias("tokens"))  # begun alike, so that an empty one begins all
    return proper_prefixes(named, "event", "tokens", ["__of"])


def surface_geometry(events: DataFrame, key: str) -> DataFrame:
    """Per prompt: events, whether all values have equally many, and whether all have the same token lengths. For disclosure only."""
    per = events.groupBy(key, "value").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.size("ids"))).alias("lengths"))
    return per.groupBy(key).agg(F.sum("n").alias("events"), (F.count_distinct("n") == 1).alias("equal_counts"), (F.count_distinct("lengths") == 1).alias("equal_lengths"))


def covering_span(starts: Column, ends: Column, start: Column, end: Column) -> Column:
    """[first, last] positions of the tokens (by their offsets) that overlap a half-open span of characters; null if none or not contiguous."""
    at = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (F.get(starts, i) < end) & (F.get(ends, i) > start))
    whole = F.size(at) == F.array_max(at) - F.array_min(at) + 1
    return F.when(F.size(at).cast("boolean") & whole, F.array(F.array_min(at), F.array_max(at)))


def pair_spans(baseline: Column, edited: Column) -> Column:
    """Of two arrays of token ids: struct(start, baseline_end, edited_end, length_delta), what lies between their common beginning and end.

    Both arrays are [0, start) alike, and alike behind their ends (not included); the common end is taken of what the beginning leaves. Equal
    arrays have empty spans. Null if either is null.
    """

    def first_difference(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        at = F.array_position(same, F.lit(False))
        return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")

    def spans(start: Column) -> Column:
        rest = lambda x: F.reverse(F.slice(x, start + 1, F.size(x)))
        behind = F.least(first_difference(rest(baseline), rest(edited)), F.size(baseline) - start, F.size(edited) - start)
        return F.get(F.transform(F.array(behind), lambda k: F.struct(start.alias("start"), (F.size(baseline) - k).alias("baseline_end"), (F.size(edited) - k).alias("edited_end"), (F.size(edited) - F.size(baseline)).alias("length_delta"))), 0)

    found = F.get(F.transform(F.array(F.least(first_difference(baseline, edited), F.size(baseline), F.size(edited))), spans), 0)
    return F.when(baseline.isNotNull() & edited.isNotNull(), found)


def pair_audit(pairs: DataFrame, key: Sequence[str], baseline: str, edited: str, span: tuple[str, str] | None = None) -> DataFrame:
    """key, start, baseline_end, edited_end, length_delta, baseline_ids and edited_ids of each pair of id arrays.

    span: columns with the first and last place of the baseline's edited tokens; a pair that differs outside it raises, and so does one
    without a difference.
    """
    found = pairs.withColumn("__s", pair_spans(F.col(baseline), F.col(edited)))
    bad = [checks.Check("unchanged_pair", found.filter(F.coalesce((F.col("__s.start") == F.col("__s.baseline_end")) & (F.col("__s.length_delta") == 0), F.lit(True))))]
    if span is not None:
        bad.append(checks.Check("edit_outside_span", found.filter((F.col("__s.start") < F.col(span[0])) | (F.col("__s.baseline_end") > F.col(span[1]) + 1))))
    checks.enforce(bad)
    part = lambda c, end: F.slice(c, F.col("__s.start") + 1, F.col(end) - F.col("__s.start"))
    return found.select(*key, "__s.*", part(baseline, "__s.baseline_end").alias("baseline_ids"), part(edited, "__s.edited_end").alias("edited_ids"))


def token_counts(df: DataFrame, family: str, ids: str) -> DataFrame:
    """(family, least, most, mean) numbers of tokens."""
    n = F.size(ids)
    return df.groupBy(family).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"))
