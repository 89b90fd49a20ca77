"""Exact optima, formulations with their size gates, and checks of solver output."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the registry: family, required and forbidden symbols, least items, most items, most capacity (null: no limit).
REGISTRY = [
    ("kp_compact_v1", "compact", "assignment", ["x"], ["f", "lambda", "z", "s", "b"], 2, 200, None),
    ("kp_arc_flow_v1", "arc_flow", "network_flow", ["f"], ["x", "lambda", "z", "s", "b"], 2, 50, 5000),
    ("kp_pattern_selection_v1", "pattern_selection", "set_partition", ["lambda"], ["x", "f", "z", "s", "b"], 2, 25, None),
    ("kp_qubo_v1", "qubo", "quadratic_unconstrained", ["x", "b"], ["f", "lambda", "z", "s"], 2, 30, 1000),
]
FORMULATIONS = tuple(r[1] for r in REGISTRY)
#: Fixed value: most patterns that are listed.
MOST_PATTERNS = 50_000
#: Items whose sets are summed at once where there are more patterns than are listed.
TAIL = 13
#: Cells of a table over capacities, above which states are kept as a list of undominated ones.
MOST_CELLS = 20_000_000


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "formulation_id string, formulation string, family string, required_symbols array<string>, forbidden_symbols array<string>, minimum_items int, maximum_items int, maximum_capacity bigint")


def gate(formulation: str, items: Column, capacity: Column) -> Column:
    """Whether an instance is small enough for a formulation."""
    row = next(r for r in REGISTRY if r[1] == formulation)
    ok = items.between(row[5], row[6]) if formulation != "compact" else items >= row[5]
    return ok if row[7] is None else ok & (capacity <= row[7])


def gates(instances: DataFrame) -> DataFrame:
    return instances.select("instance_id", *(gate(f, F.size("weights"), F.col("capacity")).alias(f) for f in FORMULATIONS))


def optimum(weights: list[int], profit: list[int], capacity: int) -> tuple[int, list[int]]:
    """(best profit, chosen items) by dynamic programming; of equal profits one with the least weight."""
    w, p = np.asarray(weights, dtype=np.int64), np.asarray(profit, dtype=np.int64)
    capacity = int(min(capacity, w.sum()))
    if len(w) * (capacity + 1) <= MOST_CELLS:
        best, took = np.zeros(capacity + 1, np.int64), np.zeros((len(w), capacity + 1), bool)
        for i in range(len(w)):
            if w[i] <= capacity:
                with_i = best[: capacity + 1 - w[i]] + p[i]
                took[i, w[i] :] = with_i > best[w[i] :]
                best[w[i] :] = np.maximum(best[w[i] :], with_i)
        room, chosen = int(np.argmax(best)), []
        value = int(best[room])
        for i in range(len(w) - 1, -1, -1):
            if took[i, room]:
                chosen.append(i)
                room -= int(w[i])
        return value, chosen[::-1]
    weight, value, back = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    for i in range(len(w)):
        fits = np.flatnonzero(weight + w[i] <= capacity)
        every_w, every_v = np.r_[weight, weight[fits] + w[i]], np.r_[value, value[fits] + p[i]]
        origin = np.r_[np.arange(len(weight)), fits]
        order = np.lexsort((-every_v, every_w))
        rising = every_v[order] > np.r_[-1, np.maximum.accumulate(every_v[order])[:-1]]
        keep = order[rising]
        back.append((origin[keep], keep >= len(weight)))
        weight, value = every_w[keep], every_v[keep]
    at, chosen = len(value) - 1, []
    for i in range(len(w) - 1, -1, -1):
        origin, taken = back[i]
        if taken[at]:
            chosen.append(i)
        at = int(origin[at])
    return int(value[-1]), chosen[::-1]


def patterns(weights: list[int], capacity: int, most: int = MOST_PATTERNS) -> tuple[list[int], bool]:
    """Bit sets of the non-empty sets of items that fit, in depth-first order, and whether more were left out."""
    found, stack = [], [(0, 0, 0)]
    while stack:
        bits, load, start = stack.pop()
        if bits:
            if len(found) == most:
                return found, True
            found.append(bits)
        stack += [(bits | 1 << i, load + weights[i], i + 1) for i in range(len(weights) - 1, start - 1, -1) if load + weights[i] <= capacity]
    return found, False


def best_pattern(weights: list[int], profit: list[int], capacity: int) -> int:
    """The most profit of all non-empty patterns, without a list of them.

    The sets of the last TAIL items are sorted by load with the most profit up to it; each
    set of the other items that fits takes the best of those that still fit beside it.
    """
    kind = np.int64 if sum(map(abs, (*weights, *profit, capacity))) < 2**62 else object
    cut = max(len(weights) - TAIL, 0)
    load, gain = np.zeros(1, kind), np.zeros(1, kind)
    for w, p in zip(weights[cut:], profit[cut:], strict=True):
        load, gain = np.r_[load, load + w], np.r_[gain, gain + p]
    order = np.argsort(load, kind="stable")
    load, gain = load[order], np.maximum.accumulate(gain[order])
    best, stack = 0, [(0, 0, 0)]
    while stack:
        used, value, i = stack.pop()
        if i == cut:
            best = max(best, value + int(gain[np.searchsorted(load, capacity - used, "right") - 1]))
            continue
        stack.append((used, value, i + 1))
        if used + weights[i] <= capacity:
            stack.append((used + weights[i], value + profit[i], i + 1))
    # No profit above 0 fits: a single item is the best there is.
    return best or max((p for w, p in zip(weights, profit, strict=True) if w <= capacity), default=0)


def by_patterns(weights: list[int], profit: list[int], capacity: int) -> tuple[int, bool]:
    """The most profit of all patterns, and whether there are more than are listed."""
    found, truncated = patterns(weights, capacity)
    if truncated:
        return best_pattern(weights, profit, capacity), True
    sums = [sum(p for i, p in enumerate(profit) if b >> i & 1) for b in found]
    return max(sums, default=0), False


def by_flow(weights: list[int], profit: list[int], capacity: int) -> int:
    """The longest path through layers of capacity states, one arc to skip an item and one to take it."""
    reach = np.full(capacity + 1, -1, np.int64)
    reach[0] = 0
    for w, p in zip(weights, profit, strict=True):
        if w <= capacity:
            taken = np.where(reach[: capacity + 1 - w] >= 0, reach[: capacity + 1 - w] + p, -1)
            reach[w:] = np.maximum(reach[w:], taken)
    return int(reach.max())


def slack_bits(capacity: int) -> list[int]:
    """Coefficients of the binary slack: powers of two and a last one, so that all of 0..capacity are sums."""
    m = int(capacity).bit_length() - 1
    return [1 << k for k in range(m)] + [capacity - (1 << m) + 1]


def penalty_of(profit: list[int]) -> int:
    """More than all profits together."""
    return 1 + int(sum(abs(p) for p in profit))


def qubo(weights: list[int], profit: list[int], capacity: int, penalty: int | None = None) -> tuple[np.ndarray, int]:
    """(Q, offset): z'Qz + offset = -profit + M (weight + slack - capacity)^2 over items and slack bits."""
    bits = slack_bits(capacity)
    a = np.array([*weights, *bits], dtype=np.int64)
    penalty = penalty or penalty_of(profit)
    q = penalty * np.outer(a, a)
    q[np.diag_indices(len(a))] -= 2 * penalty * capacity * a + np.array([*profit, *[0] * len(bits)])
    return q, penalty * capacity * capacity


def by_qubo(weights: list[int], profit: list[int], capacity: int, penalty: int | None = None) -> int:
    """The least energy over all items and slack bits, negated.

    An energy depends on the items' profit and weight and on the slack's value only. For
    each weight the most profit is kept, for each of them the slack that comes nearest is
    taken, whether the weight fits or not. Weights so large that the penalty alone passes
    all profits are above the energy of no items and are left out.
    """
    penalty, bits = penalty or penalty_of(profit), slack_bits(capacity)
    slack = np.zeros(1, np.int64)
    for b in bits:
        slack = np.unique(np.r_[slack, slack + b])
    most = capacity + math.isqrt(sum(p for p in profit if p > 0) // penalty) + 1
    value = np.full(most + 1, np.iinfo(np.int64).min // 2)
    value[0] = 0
    for w, p in zip(weights, profit, strict=True):
        if w <= most:
            value[w:] = np.maximum(value[w:], value[: most + 1 - w] + p)
    load = np.flatnonzero(value > np.iinfo(np.int64).min // 4)
    at = np.clip(np.searchsorted(slack, capacity - load), 1, slack.size - 1)
    miss = np.minimum(np.abs(load + slack[at] - capacity), np.abs(load + slack[at - 1] - capacity))
    return int((value[load] - penalty * miss * miss).max())


def solutions(instances: DataFrame) -> DataFrame:
    """(instance_id, objective, selected, selected_weight) of an exact optimum."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [optimum([*w], [*p], int(c)) for w, p, c in zip(f.weights, f.profit, f.capacity, strict=True)]
            yield pd.DataFrame({"instance_id": f.instance_id, "objective": [v for v, _ in got], "selected": [s for _, s in got], "selected_weight": [int(sum(w[i] for i in s)) for w, (_, s) in zip(f.weights, got, strict=True)]})

    return instances.select("instance_id", "weights", "profit", "capacity").mapInPandas(run, "instance_id string, objective bigint, selected array<int>, selected_weight bigint")


def run_formulations(instances: DataFrame, time_limit: float | None = None) -> DataFrame:
    """(instance_id, formulation, seconds, good, objective, truncated): a row per formulation whose gate is open.

    A formulation that fails has nulls and good 0; an objective of 0 stays 0. One that
    takes longer than ``time_limit`` seconds keeps its objective, which is exact, with good 0.
    ``truncated``: more patterns than are listed; the objective is that of all of them.
    """
    open_to = gates(instances).unpivot(["instance_id"], list(FORMULATIONS), "formulation", "open").where("open").drop("open")
    rows = instances.select("instance_id", "weights", "profit", "capacity").join(open_to, "instance_id")

    def one(name: str, w: list[int], p: list[int], c: int) -> tuple[int, bool]:
        if name == "pattern_selection":
            return by_patterns(w, p, c)
        return {"compact": lambda: optimum(w, p, c)[0], "arc_flow": lambda: by_flow(w, p, c), "qubo": lambda: by_qubo(w, p, c)}[name](), False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                began = time.perf_counter()
                try:
                    value, cut = one(r.formulation, [int(x) for x in r.weights], [int(x) for x in r.profit], int(r.capacity))
                    took = time.perf_counter() - began
                    out.append((r.instance_id, r.formulation, took, int(time_limit is None or took <= time_limit), value, cut))
                except (ValueError, MemoryError, OverflowError):
                    out.append((r.instance_id, r.formulation, None, 0, None, None))
            yield pd.DataFrame(out, columns=["instance_id", "formulation", "seconds", "good", "objective", "truncated"]).astype({"objective": "Int64", "truncated": "boolean"})

    return rows.mapInPandas(run, "instance_id string, formulation string, seconds double, good int, objective bigint, truncated boolean")


def wide(results: DataFrame, value: str) -> DataFrame:
    """One of the tables performance (seconds), good and objectives: a row per instance, a column per formulation."""
    return results.groupBy("instance_id").pivot("formulation", list(FORMULATIONS)).agg(F.first(value))


def variable_family(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*?)(?:[_\[]\d.*)?$", 1)


def variable_index(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"[_\[](\d+)", 1), F.lit("")).cast("int")


def signature_errors(outputs: DataFrame) -> DataFrame:
    """Adds what is wrong with the numbers of variables of each family.

    ``outputs``: formulation_id, n, variables (map of values); the registry is joined.
    """
    spark = outputs.sparkSession
    rows = outputs.join(F.broadcast(registry(spark).select("formulation_id", "required_symbols", "forbidden_symbols")), "formulation_id")
    families = F.transform(F.map_keys("variables"), variable_family)
    count = lambda s: F.size(F.filter("__families", lambda f: f == s))
    form, n = F.col("formulation_id"), F.col("n")
    rows = rows.withColumn("__families", families)
    rules = [
        ((form == "kp_compact_v1") & (count(F.lit("x")) != n), "x_count"), ((form == "kp_arc_flow_v1") & (count(F.lit("f")) < n), "f_count"),
        ((form == "kp_pattern_selection_v1") & (count(F.lit("lambda")) < 1), "lambda_count"), ((form == "kp_qubo_v1") & (count(F.lit("x")) != n), "x_count"), ((form == "kp_qubo_v1") & (count(F.lit("b")) < 1), "b_count"),
    ]
    missing = F.transform(F.filter("required_symbols", lambda s: count(s) == 0), lambda s: F.concat(F.lit("missing_"), s))
    forbidden = F.transform(F.filter("forbidden_symbols", lambda s: count(s) > 0), lambda s: F.concat(F.lit("forbidden_"), s))
    other = F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)), lambda x: x.isNotNull())
    return rows.withColumn("signature_errors", F.concat(missing, forbidden, other)).drop("__families", "required_symbols", "forbidden_symbols")


def objective_errors(outputs: DataFrame) -> DataFrame:
    """Adds what is wrong with the linear objective (map of coefficients) against the profits."""
    form, terms = F.col("formulation_id"), F.map_entries("objective_linear")
    on_x = F.filter(terms, lambda e: variable_family(e["key"]) == "x")
    sign = F.when(form == "kp_qubo_v1", -1).otherwise(1)
    allowed = F.when(form == "kp_qubo_v1", 1e-6).otherwise(1e-9)
    outside = F.exists(on_x, lambda e: variable_index(e["key"]) >= F.size("profit"))
    wrong = F.exists(on_x, lambda e: F.abs(e["value"] - sign * F.get("profit", variable_index(e["key"]))) > allowed)
    by_items = form.isin("kp_compact_v1", "kp_qubo_v1")
    rules = [
        (by_items & outside, "item_out_of_range"), (by_items & ~outside & wrong, "coefficient"),
        ((form == "kp_pattern_selection_v1") & ~F.exists(terms, lambda e: variable_family(e["key"]) == "lambda"), "no_lambda"),
        ((form == "kp_arc_flow_v1") & ~F.exists(terms, lambda e: e["value"] > 1e-9), "no_positive_arc"),
    ]
    return outputs.withColumn("objective_errors", F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules)), lambda x: x.isNotNull()))


def selected_items(variables: Column) -> Column:
    """Items whose x is above one half, ascending."""
    on = F.map_filter(variables, lambda k, v: (v > 0.5) & (variable_family(k) == "x"))
    return F.array_sort(F.array_distinct(F.transform(F.map_keys(on), variable_index)))


def feasibility_errors(weights: Column, capacity: Column, selected: Column) -> Column:
    """Items out of range, and a total weight above the capacity."""
    inside = F.filter(selected, lambda i: (i >= 0) & (i < F.size(weights)))
    load = F.aggregate(F.transform(inside, lambda i: F.get(weights, i)), F.lit(0).cast("long"), lambda a, w: a + w)
    rules = [(F.size(inside) < F.size(selected), "item_out_of_range"), (load > capacity, "over_capacity")]
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)), lambda x: x.isNotNull())
