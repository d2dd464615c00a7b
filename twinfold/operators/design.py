"""Factorial designs: grids, edited members, rendering with character spans, splits and signatures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import set_key
from .ordered import sums_before
from .pinning import pinned, scratch_folder


def grid(spark: SparkSession, factors: Mapping[str, Sequence], replicates: int = 1) -> DataFrame:
    """The full factorial: one row per replicate and combination, in order of `ord`. Levels are exploded inside the plan."""
    base = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    full = reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), factors.items(), base)
    size = reduce(lambda a, b: a * b, (len(v) for v in factors.values()), 1)
    place, step = F.lit(0).cast("long"), size
    for name, levels in factors.items():
        step //= len(levels)
        place = place + (F.array_position(F.array(*map(F.lit, levels)), F.col(name)) - 1) * step
    return full.withColumn("ord", F.col("replicate") * F.lit(size).cast("long") + place)


def with_members(histories: DataFrame, families: Mapping[str, int]) -> DataFrame:
    """Each history's rows: a family has members 0 and 1, or 0 alone."""
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(m).alias("member")) for f, n in families.items() for m in range(n)))
    return histories.withColumn("__r", F.explode(rows)).select(*histories.columns, "__r.family", "__r.member")


def edited_member(fields: Column, edited: Column, value: Column, member: Column) -> Column:
    """The fields map, with one key replaced in member 1."""
    return F.when(member == 1, set_key(fields, edited, value)).otherwise(fields)


def render(lines: Sequence[Column]) -> tuple[Column, list[Column]]:
    """A prompt of lines joined by newlines and each line's [start, end) span in code points."""
    spans, at = [], F.lit(0)
    for line in lines:
        spans.append(F.array(at.cast("int"), (at + F.length(line)).cast("int")))
        at = at + F.length(line) + 1
    return F.array_join(F.array(*lines), "\n"), spans


def differs_only_inside(a: Column, b: Column, span: Column) -> Column:
    """Whether two texts agree before a span of a and after it (counted from the end)."""
    start, tail = F.get(span, 0), F.length(a) - F.get(span, 1)
    same_end = F.right(a, tail) == F.right(b, tail)
    return (F.substring(a, F.lit(1), start) == F.substring(b, F.lit(1), start)) & F.when(tail > 0, same_end).otherwise(True)


def orientation_key(a: Column, b: Column) -> Column:
    """One signature for a pair of values in either orientation."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def legal_orders(items: Sequence[str], before: Sequence[tuple[str, str]]) -> list[tuple[str, ...]]:
    """Permutations of a few items that keep precedence constraints."""
    return [p for p in permutations(items) if all(p.index(a) < p.index(b) for a, b in before)]


def split_groups(df: DataFrame, group: str, shares: Sequence[tuple[str, float]], seed: str) -> DataFrame:
    """Whole groups to splits in exact shares (half-even rounding), by the order of a seeded md5 of the group."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.col(group).cast("string")))
    names = df.select(group).distinct().withColumn("__k", key)
    total = names.agg(F.count("*").alias("__n"))
    ranked = sums_before(names, [], F.substring("__k", 1, 3), [F.col("__k"), F.col(group)], {"__r0": F.lit(1)}).withColumn("__r", F.col("__r0") + 1).crossJoin(F.broadcast(total))
    split, upto = F.lit(shares[-1][0]), 0.0
    edges = []
    for name, share in shares[:-1]:
        upto += share
        edges.append((name, upto))
    for name, edge in reversed(edges):
        split = F.when(F.col("__r") <= F.bround(F.col("__n") * F.lit(edge)), name).otherwise(split)
    return df.join(ranked.select(group, split.alias("split")), group)


def first_cell_sample(df: DataFrame, cells: Sequence[str], order: str) -> DataFrame:
    """The first row of each cell."""
    return df.groupBy(*cells).agg(F.min_by(F.struct(*(c for c in df.columns if c not in cells)), order).alias("__x")).select(*cells, "__x.*")


def crossed(df: DataFrame, factors: Mapping[str, Sequence]) -> DataFrame:
    """Each row of df in every combination of the factors' levels (a protocol's few)."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), factors.items(), df)


def derived_states(states: Column, action: Column, historical: Column, current: Column, actions: Sequence[str]) -> dict[str, Column]:
    """A history's states from its factors: four states rotated by (2 action + 2 historical + current) mod 4, two to each of two actions.

    policy maps states to actions; `current` calls for action number `action`; one old value implies the other action (wrong), one the same
    (correct). historical and current are order bits; the stratum is aligned where they agree.
    """
    turn = (2 * action + 2 * historical + current) % 4
    turned = F.concat(F.slice(states, turn + 1, 4 - turn), F.slice(states, F.lit(1), turn))
    at = lambda i: F.get(turned, i)
    policy = F.map_from_arrays(turned, F.array(*(F.lit(actions[i // 2]) for i in range(4))))
    return {
        "states": turned, "policy": policy, "current": at(2 * action), "other_current": at((2 * action + 2) % 4), "old_correct": at(2 * action + 1), "old_wrong": at(2 * (1 - action)),
        "answer": F.element_at(F.array(*map(F.lit, actions)), action + 1), "stratum": F.when(historical == current, "aligned").otherwise("reversed"),
    }


def balanced_value(number: Column, role: Column, values: Sequence[str], roles: int) -> Column:
    """The value of a role in a numbered history: each value has each role equally often over len(values) histories, and a history's roles differ.

    A cyclic Latin square: role r of history i takes value (i + r * step) mod len(values); step keeps roles apart.
    """
    n = len(values)
    if roles > n:
        raise ValueError("more roles than values")
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number + role * (n // roles), F.lit(n)) + 1).cast("int"))


def fractional_allocation(pair: Column, attribute: Column, first: Sequence[Sequence[int]]) -> dict[str, Column]:
    """A half fraction of pair x attribute x orientation x relation: orientation (pair + attribute) mod 2, relation 0 for the attributes that
    `first` lists for the pair, else 1."""
    listed = F.get(F.array(*(F.array(*map(F.lit, x)) for x in first)), pair.cast("int"))
    return {"orientation": (pair + attribute) % 2, "relation": F.when(F.array_contains(listed, attribute), 0).otherwise(1)}


def fresh_signatures(df: DataFrame, index: str, signature: Callable[[Column, Column], Column], used: DataFrame, attempts: int = 1000) -> DataFrame:
    """(index, attempt, signature): each row's first attempt whose signature is neither used nor taken by a row before it.

    Rejection sampling for all rows at once: each proposes its next attempt, a signature goes to the smallest index that has asked for it,
    and who loses one goes on. That is the result of drawing row by row. used: a column `signature`. Raises if a row runs out of attempts.
    """
    asked = df.select(index, F.lit(0).alias("attempt"))
    while True:
        proposed = asked.select(index, "attempt", signature(F.col(index), F.col("attempt")).alias("signature"))
        first = proposed.groupBy("signature").agg(F.min(index).alias("__first"))
        barred = used.select("signature", F.lit(True).alias("__used")).distinct()
        judged = proposed.join(first.hint("merge"), "signature").join(barred.hint("merge"), "signature", "left").withColumn("__lost", (F.col(index) != F.col("__first")) | F.col("__used").isNotNull()).persist()
        facts = judged.agg(F.count_if(F.col("__lost")).alias("lost"), F.max("attempt").alias("most")).first()
        if not facts["lost"]:
            return judged.select(index, "attempt", "signature")
        if facts["most"] >= attempts:
            raise ValueError(f"no fresh signature in {attempts} attempts")
        asked = pinned(judged.select(index, (F.col("attempt") + F.col("__lost").cast("int")).alias("attempt")))
        judged.unpersist()


#: Rows of `fresh_keyed` whose keys one task makes.
KEYED = 10_000


def fresh_keyed(df: DataFrame, index: str, keys: Callable[[Column, Column], Column], used: DataFrame, attempts: int = 1000) -> DataFrame:
    """(index, attempt, keys): each row's first attempt none of whose keys is used or belongs to a row before it.

    keys: an array of signatures of (index, attempt), such as a target's and its whole history's, or both orientations of a pair. A row has
    all its keys or none, so a row that goes on frees what it asked for. All rows are settled together, in rounds: each takes its first attempt
    that the present choices of the rows before it leave free. A row asks for its first attempt alone, and for twice as many whenever all that it
    asked for are taken, so most rows are in a round once; it takes the first new one unseen, to be judged in the next round. Where a round
    changes no row, each row's attempt is free and all before it aren't: by induction on the index that is the result of drawing one by one. It
    is reached, as a row stands still soon after those before it do. used: a column `signature`. Raises if a row runs out of attempts
    or has no index; rows of one index have the same keys. Keys are made once, dealt to tasks, and kept as files in the shared checkpoint folder.
    All joins sort both sides: none is small where df is large, and Spark takes rows before their keys are exploded for their size.
    """
    spark, asked = df.sparkSession, scratch_folder(df.sparkSession)
    barred = pinned(used.filter("signature is not null").select("signature", F.lit(None).cast(df.schema[index].dataType).alias("__owner")).distinct())
    settled = pinned(df.select(index).distinct().select(index, F.lit(0).alias("attempt"), F.lit(0).alias("__before"), F.lit(1).alias("__asked")))
    if not settled.filter(F.col(index).isNull()).isEmpty():
        raise ValueError(f"a row without {index}")
    more, offers = settled.count(), None
    while True:
        new = settled.filter("__asked > __before").select(index, F.explode(F.sequence("__before", F.col("__asked") - 1)).alias("attempt")).repartition(1 + more // KEYED)
        new = new.withColumn("keys", keys(F.col(index), F.col("attempt")))
        if more or offers is None:
            new.write.mode("append").parquet(asked)
            offers = spark.read.schema(new.schema).parquet(asked)
        chosen = offers.join(settled.select(index, "attempt").hint("merge"), [index, "attempt"])
        owners = chosen.select(F.col(index).alias("__owner"), F.explode("keys").alias("signature")).groupBy("signature").agg(F.min("__owner").alias("__owner")).unionByName(barred)
        met = offers.select(index, "attempt", F.explode("keys").alias("signature")).join(owners.hint("merge"), "signature").filter(F.col("__owner").isNull() | (F.col("__owner") < F.col(index)))
        judged = settled.join(met.groupBy(index).agg(F.collect_set("attempt").alias("__met")).hint("merge"), index, "left")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.col("__asked") - 1), F.coalesce("__met", F.array().cast("array<int>"))))
        judged = judged.select(index, F.coalesce(free, F.when(F.col("__asked") < attempts, F.col("__asked"))).alias("attempt"), F.col("attempt").alias("__was"), F.col("__asked").alias("__before"), F.when(free.isNull(), F.least(2 * F.col("__asked"), F.lit(attempts))).otherwise(F.col("__asked")).alias("__asked"))
        settled = pinned(judged)
        facts = settled.agg(F.count_if(~F.col("attempt").eqNullSafe(F.col("__was"))).alias("moved"), F.count_if(F.col("attempt").isNull()).alias("without"), F.coalesce(F.sum(F.col("__asked") - F.col("__before")), F.lit(0)).alias("more")).first()
        more = facts["more"]
        if not facts["moved"]:
            if facts["without"]:
                raise ValueError(f"no fresh signature in {attempts} attempts")
            return df.select(index).join(chosen.hint("merge"), index)


def order_ways(items: Sequence[str], before: Sequence[tuple[str, str]]) -> list[int]:
    """By set of items (a bit each): in how many orders the others can follow once these have stood; 0 if these alone can't stand first."""
    n = len(items)
    need = [sum(1 << items.index(a) for a, b in before if b == x) for x in items]
    ways = [0] * (1 << n)
    ways[-1] = 1
    for m in range((1 << n) - 2, -1, -1):
        if all(m & need[i] == need[i] for i in range(n) if m >> i & 1):
            ways[m] = sum(ways[m | 1 << i] for i in range(n) if not m >> i & 1 and m & need[i] == need[i])
    return ways


def nth_order(number: Column, items: Sequence[str], before: Sequence[tuple[str, str]]) -> Column:
    """The order of the items with this number among those that keep the precedence, in the order of `legal_orders`; null beyond them.

    Item by item: the orders that begin with each candidate are counted (see order_ways; a table of 2 ^ items numbers), and the number says
    into whose share it falls. No list of orders is made.
    """
    n = len(items)
    ways = F.array(*(F.lit(w).cast("long") for w in order_ways(items, before)))
    need = F.array(*(F.lit(sum(1 << items.index(a) for a, b in before if b == x)) for x in items))
    names = F.array(*map(F.lit, items))

    def step(at: Column, _: Column) -> Column:
        def offer(found: Column, i: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), i)
            free = (found["item"] < 0) & (at["mask"].bitwiseAND(bit) == 0) & (at["mask"].bitwiseAND(F.get(need, i)) == F.get(need, i))
            share = F.get(ways, at["mask"].bitwiseOR(bit))
            here = free & (found["left"] < share)
            return F.struct(F.when(free & ~here, found["left"] - share).otherwise(found["left"]).alias("left"), F.when(here, i).otherwise(found["item"]).alias("item"))

        taken = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.struct(at["left"].alias("left"), F.lit(-1).alias("item")), offer)
        return F.get(F.transform(F.array(taken), lambda taken: moved(at, taken)), 0)  # what is taken is computed once

    def moved(at: Column, taken: Column) -> Column:
        return F.struct(at["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1), taken["item"])).alias("mask"), taken["left"].alias("left"), F.concat(at["order"], F.array(F.get(names, taken["item"]))).alias("order"))

    start = F.struct(F.lit(0).alias("mask"), number.cast("long").alias("left"), F.array().cast("array<string>").alias("order"))
    total = order_ways(items, before)[0]
    return F.when((number >= 0) & (number < total), F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)["order"])


def _sampled(values: Sequence[str], n: Column, *seed: Column) -> Column:
    """n of the values without replacement, by a seeded md5 of each."""
    order = F.array_sort(F.transform(F.array(*map(F.lit, values)), lambda v: F.struct(F.md5(F.concat_ws(":", *(s.cast("string") for s in seed), v)).alias("k"), v.alias("v"))))
    return F.transform(F.slice(order, F.lit(1), n), lambda x: x["v"])


def version_chains(histories: DataFrame, depth: str, number: str, values: Sequence[str], seed: str, excluded: DataFrame | None = None, fresh: bool = True) -> DataFrame:
    """Histories of two variables with depth + 1 versions each: history, depth, number, attempt, x, z, orientation, block_order.

    histories: columns depth and number (0 and up within a depth). All versions of a history differ; no two histories, nor one and an
    `excluded` (a column `signature`), have the same versions in either orientation. Orientations and block orders alternate, so four
    histories in a row have each pair of them once. Without `fresh` each history has its first attempt, whatever others have.
    """
    m = F.col(depth) + 1
    rows = histories.select(depth, number).withColumn("__id", F.struct(F.col(depth).cast("long").alias("d"), F.col(number).cast("long").alias("h")))
    named = lambda d, x, z: F.concat_ws("|", d.cast("string"), F.array_join(x, ","), F.array_join(z, ","))
    sides = lambda d, x, z: F.array(named(d, x, z), named(d, z, x))

    def drawn(i: Column, attempt: Column) -> Column:
        return _sampled(values, (2 * (i["d"] + 1)).cast("int"), F.lit(seed), i["d"], i["h"], attempt)

    def keys(i: Column, attempt: Column) -> Column:
        both = drawn(i, attempt)
        n = (i["d"] + 1).cast("int")
        return F.get(F.transform(F.array(both), lambda both: sides(i["d"], F.slice(both, F.lit(1), n), F.slice(both, n + 1, n))), 0)  # what is drawn is computed once

    none = histories.sparkSession.createDataFrame([], "signature string")
    found = fresh_keyed(rows.select("__id"), "__id", keys, none if excluded is None else excluded) if fresh else rows.select("__id", F.lit(0).alias("attempt"))
    both = found.withColumn("__v", drawn(F.col("__id"), F.col("attempt"))).select(F.col("__id.d").alias(depth), F.col("__id.h").alias(number), "attempt", "__v")
    h = F.col(number)
    return both.select(
        F.concat(F.lit(seed + ":d"), depth, F.lit(":"), number).alias("history"), depth, number, "attempt", F.slice("__v", F.lit(1), m.cast("int")).alias("x"), F.slice("__v", (m + 1).cast("int"), m.cast("int")).alias("z"),
        (h % 2).cast("int").alias("orientation"), F.when(F.floor(h / 2) % 2 == 0, F.array(F.lit("x"), F.lit("z"))).otherwise(F.array(F.lit("z"), F.lit("x"))).alias("block_order"),
    )


def chain_members(chains: DataFrame, depth: str, values: Sequence[str], seed: str) -> DataFrame:
    """Each history's rows: every version of either variable edited or not (direction 0 and 1), asked for either variable's newest version.

    history, depth, variable, version, age (from the newest), query, direction, source, replacement (a value that the history lacks), answer.
    """
    sides = F.explode(F.array(F.struct(F.lit("x").alias("variable"), F.col("x").alias("own")), F.struct(F.lit("z").alias("variable"), F.col("z").alias("own")))).alias("s")
    each = chains.select("history", depth, "x", "z", sides).select("history", depth, "x", "z", "s.*").select("*", F.posexplode("own").alias("version", "source"))
    spare = F.array_except(F.array(*map(F.lit, values)), F.concat("x", "z"))
    order = F.array_min(F.transform(spare, lambda v: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "history", "variable", F.col("version").cast("string"), v)).alias("k"), v.alias("v"))))
    rows = crossed(each.withColumn("replacement", order["v"]), {"query": ["x", "z"], "direction": [0, 1]})
    newest = F.when(F.col("query") == "x", F.element_at("x", -1)).otherwise(F.element_at("z", -1))
    edited = (F.col("direction") == 1) & (F.col("query") == F.col("variable")) & (F.col("version") == F.col(depth))
    return rows.select("history", depth, "variable", "version", (F.col(depth) - F.col("version")).alias("age"), "query", "direction", "source", "replacement", F.when(edited, F.col("replacement")).otherwise(newest).alias("answer"))


def partition_ids(df: DataFrame, group: str, size: int, seed: str) -> DataFrame:
    """(group, part): the `size` groups that come first by a seeded md5 are `discovery`, the others `heldout`."""
    names = df.select(group).distinct().withColumn("__k", F.md5(F.concat(F.lit(seed + ":"), F.col(group).cast("string"))))
    ranked = sums_before(names, [], F.substring("__k", 1, 3), [F.col("__k"), F.col(group)], {"__r": F.lit(1)})
    return ranked.select(group, F.when(F.col("__r") < size, "discovery").otherwise("heldout").alias("part"))


def split_weighted(df: DataFrame, group: str, weights: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """(group, part): all groups, by a seeded md5, in parts of floor(n * weight / total); the first parts take one more each of what is left."""
    names = df.select(group).distinct().withColumn("__k", F.md5(F.concat(F.lit(seed + ":"), F.col(group).cast("string"))))
    n, total = F.col("__n"), sum(w for _, w in weights)
    floors = [F.floor(n * w / F.lit(total)) for _, w in weights]
    left = n - sum(floors[1:], floors[0])
    part, end = F.lit(None).cast("string"), F.lit(0)
    ranked = sums_before(names, [], F.substring("__k", 1, 3), [F.col("__k"), F.col(group)], {"__r": F.lit(1)}).crossJoin(F.broadcast(names.agg(F.count("*").alias("__n"))))
    for i, (name, _) in enumerate(weights):
        end = end + floors[i] + F.when(left > i, 1).otherwise(0)
        part = F.coalesce(part, F.when(F.col("__r") < end, name))
    return ranked.select(group, part.alias("part"))


def exact_partition(ids: Sequence[str], size: int, seed: int) -> tuple[list[str], list[str]]:
    """The partition by numpy's generator, whose one stream is part of the result: for a protocol's list of histories."""
    names = sorted(set(ids))
    if not 1 <= size < len(names):
        raise ValueError("the first part must leave at least one id")
    np.random.default_rng(seed).shuffle(names)
    return names[:size], names[size:]
