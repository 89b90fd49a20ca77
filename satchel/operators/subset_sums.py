"""Exact subset-sum features: a dynamic program over loads.

The state is a row per instance and load: how many subsets have it, and the sums of their
sizes and of the squares of these. Each round adds one item to all instances: the states
together with the shifted ones, grouped by load.

Instances whose states are few and whose counts fit 64 bits (``small``) go through the
rounds in their task, many at a time, without a shuffle. All others share a relation of
loads, with a union and a grouping that combines before the shuffle in each round. There
counts are decimals, as they pass 64 bits beyond 63 items; past 38 digits a sum raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.arrays import gcd
from satchel.functions.tasks import dealt, stored

NUMBER = "decimal(38,0)"
#: Most items and most loads of an instance whose rounds run in a task: sums of n * n * 2 ** n fit 64 bits up to 50 items.
MOST_ITEMS, MOST_LOADS = 50, 1 << 16
#: States of a task that are held together.
AT_ONCE = 1 << 21
SUMS = ("feasible", "mean", "size", "square", "exact", "reached", "most", "variance")
#: Rounds between stored tables, so that plans stay short.
KEPT = 4


def faults(sizes: Column, capacity: Column) -> Column:
    """Why there are no features: a capacity above 0 and items that fit it are needed. Null if nothing is wrong."""
    bad = F.exists(sizes, lambda s: s.isNull() | (s <= 0) | (s > capacity))
    return F.when(sizes.isNull() | capacity.isNull() | (F.size(sizes) == 0) | (capacity <= 0), "no_items_or_capacity").when(F.coalesce(bad, F.lit(True)), "item_without_size_or_too_large")


def prefix(sizes: Column, capacity: Column) -> Column:
    """How many of the first sizes fit together."""
    step = lambda a, s: F.struct((a["load"] + s).alias("load"), (a["n"] + (a["load"] + s <= capacity).cast("int")).alias("n"))
    return F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("load"), F.lit(0).alias("n")), step)["n"]


def load_states(instances: DataFrame) -> DataFrame:
    """(instance_id, load, ways, chosen, squares) for each load that a subset reaches, the empty one included.

    ``instances``: instance_id, sizes and capacity in whole units. ``chosen`` and
    ``squares`` sum the sizes of the subsets and their squares.
    """
    items = stored(instances.select("instance_id", "capacity", F.posexplode("sizes").alias("k", "size")), "items")
    zero, one = F.lit(0).cast(NUMBER), F.lit(1).cast(NUMBER)
    states = instances.select("instance_id", F.lit(0).cast("long").alias("load"), one.alias("ways"), zero.alias("chosen"), zero.alias("squares"))
    rounds = items.agg(F.max("k")).head()[0]
    for k in range(0 if rounds is None else rounds + 1):
        more = states.join(items.where(F.col("k") == k), "instance_id").where(F.col("load") + F.col("size") <= F.col("capacity"))
        more = more.select("instance_id", (F.col("load") + F.col("size")).alias("load"), "ways", (F.col("chosen") + F.col("ways")).cast(NUMBER).alias("chosen"), (F.col("squares") + 2 * F.col("chosen") + F.col("ways")).cast(NUMBER).alias("squares"))
        states = states.unionByName(more).groupBy("instance_id", "load").agg(*(F.sum(c).cast(NUMBER).alias(c) for c in ("ways", "chosen", "squares")))
        states = stored(states, "loads") if k % KEPT == KEPT - 1 else states
    return stored(states, "loads")


def _by_relation(rows: DataFrame) -> DataFrame:
    """``rows`` with the SUMS over the relation of loads."""
    found = load_states(rows).where("load > 0").join(rows.select("instance_id", "capacity"), "instance_id")
    found = found.withColumns({"w": F.col("ways").cast("double"), "x": F.col("load").cast("double")})
    whole = found.groupBy("instance_id").agg(
        F.sum("w").alias("feasible"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), (F.sum("chosen").cast("double") / F.sum("w")).alias("size"), (F.sum("squares").cast("double") / F.sum("w")).alias("square"),
        F.sum(F.when(F.col("load") == F.col("capacity"), F.col("w")).otherwise(0.0)).alias("exact"), F.count(F.lit(1)).alias("reached"), F.max("load").alias("most"),
    )
    spread = found.join(whole.select("instance_id", "mean"), "instance_id").groupBy("instance_id").agg((F.sum(F.pow(F.col("x") - F.col("mean"), 2) * F.col("w")) / F.sum("w")).alias("variance"))
    return rows.join(whole, "instance_id").join(spread, "instance_id").select("instance_id", "sizes", "capacity", *SUMS)


def small(sizes: Column, capacity: Column) -> Column:
    """Whether an instance's rounds run in its task: at most MOST_ITEMS items, and MOST_LOADS loads that subsets can reach."""
    return (F.size(sizes) <= MOST_ITEMS) & (F.least(F.pow(F.lit(2.0), F.size(sizes)), capacity + 1.0) <= MOST_LOADS) & (capacity < 1 << 40)


def sums_of_loads(sizes: np.ndarray, ends: np.ndarray, capacity: np.ndarray) -> dict[str, np.ndarray]:
    """The SUMS of instances whose sizes lie one after another, each up to its end; all rounds on whole arrays."""
    count = np.diff(ends, prepend=0)
    begin, m = ends - count, len(count)
    who, load, ways = np.arange(m), np.zeros(m, np.int64), np.ones(m, np.int64)
    chosen, squares, done = np.zeros(m, np.int64), np.zeros(m, np.int64), []
    for k in range(int(count.max(initial=0))):
        on = count[who] > k
        done.append([x[~on] for x in (who, load, ways, chosen, squares)])
        who, load, ways, chosen, squares = (x[on] for x in (who, load, ways, chosen, squares))
        after = load + sizes[begin[who] + k]
        fits = after <= capacity[who]
        who, load = np.r_[who, who[fits]], np.r_[load, after[fits]]
        ways, chosen, squares = np.r_[ways, ways[fits]], np.r_[chosen, (chosen + ways)[fits]], np.r_[squares, (squares + 2 * chosen + ways)[fits]]
        order = np.lexsort((load, who))
        who, load = who[order], load[order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (load[1:] != load[:-1])])
        who, load = who[first], load[first]
        ways, chosen, squares = (np.add.reduceat(x[order], first) for x in (ways, chosen, squares))
    who, load, ways, chosen, squares = (np.concatenate(x) for x in zip(*done, (who, load, ways, chosen, squares), strict=True))
    some = load > 0
    who, load, ways, chosen, squares = (x[some] for x in (who, load, ways, chosen, squares))
    by = lambda x: np.bincount(who, x, m)
    most = np.zeros(m, np.int64)
    np.maximum.at(most, who, load)
    feasible = by(ways)
    mean = by(load * ways.astype(float)) / feasible
    return {
        "feasible": feasible, "mean": mean, "size": by(chosen) / feasible, "square": by(squares) / feasible, "exact": by(np.where(load == capacity[who], ways, 0)),
        "reached": np.bincount(who, minlength=m), "most": most, "variance": by((load - mean[who]) ** 2 * ways) / feasible,
    }


def _in_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` with the SUMS, found batch by batch; AT_ONCE bounds the states that are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["sizes"].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch["sizes"].value_lengths().to_numpy(zero_copy_only=False))
            capacity = batch["capacity"].to_numpy(zero_copy_only=False)
            count = np.diff(ends, prepend=0)
            part = np.cumsum(np.minimum(np.exp2(count), capacity + 1.0)) // AT_ONCE
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                low = int(ends[at[0]] - count[at[0]])
                found = sums_of_loads(sizes[low : int(ends[at[-1]])], ends[at] - low, capacity[at])
                held = batch.slice(int(at[0]), len(at))
                yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array(found[c]) for c in SUMS)], names=[*held.schema.names, *SUMS])

    kinds = ", ".join(f"`{c}` {'bigint' if c in ('reached', 'most') else 'double'}" for c in SUMS)
    return dealt(rows.select("instance_id", "sizes", "capacity")).mapInArrow(run, f"instance_id string, sizes array<bigint>, capacity bigint, {kinds}")


def subset_sum_features(instances: DataFrame) -> DataFrame:
    """The 12 features of feasible subsets, a row per instance without a fault (``faults``).

    ``instances``: instance_id, sizes (array of longs), capacity. Sizes and capacity are
    divided by their greatest common divisor first.
    """
    sound = instances.where(faults(F.col("sizes"), F.col("capacity")).isNull()).select("instance_id", F.col("sizes").cast("array<bigint>").alias("sizes"), F.col("capacity").cast("long").alias("capacity"))
    unit = gcd(F.concat("sizes", F.array("capacity")))
    rows = sound.withColumn("unit", unit).select("instance_id", F.expr("transform(sizes, s -> s div unit)").alias("sizes"), F.expr("capacity div unit").alias("capacity"))
    rows = stored(rows, "lattice")
    few = small(F.col("sizes"), F.col("capacity"))
    found = _in_tasks(rows.where(few))
    if (rest := rows.where(~few)).head(1):
        found = found.unionByName(_by_relation(rest))
    row = found.withColumn("n", F.size("sizes"))
    low, high = prefix(F.array_sort("sizes"), F.col("capacity")), prefix(F.reverse(F.array_sort("sizes")), F.col("capacity"))
    c, n = F.col("capacity"), F.col("n")
    values = {
        "smallest_prefix_count": low, "smallest_prefix_fraction": low / n, "largest_prefix_count": high, "largest_prefix_fraction": high / n,
        "feasible_fraction": F.col("feasible") / (F.pow(F.lit(2.0), n) - 1), "exact_fill_fraction_of_feasible": F.col("exact") / F.col("feasible"),
        "feasible_load_mean_ratio": F.col("mean") / c, "feasible_load_std_ratio": F.sqrt("variance") / c,
        "feasible_cardinality_mean_ratio": F.col("size") / n, "feasible_cardinality_std_ratio": F.sqrt(F.greatest(F.col("square") - F.col("size") * F.col("size"), F.lit(0.0))) / n,
        "reachable_positive_load_fraction": F.col("reached") / c, "maximum_load_ratio": F.col("most") / c,
    }
    return row.select("instance_id", *(v.cast("double").alias(f"subset_{k}") for k, v in values.items()))
