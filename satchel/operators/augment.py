"""Seeded generation of instances: mutations, random classes, and acceptance.

Attempt k draws from its own generator, seeded by ``seed + STRIDE * k``, so attempts are
independent rows and the result does not depend on how they are dealt to tasks. The order
of draws inside an attempt fixes its result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions.tasks import stored
from satchel.operators.features import all_features
from satchel.operators.hashing import canonical_hash, dedupe, numbered, validated

#: Distance of the attempts' seeds, share of random attempts, attempts per wanted instance, largest value of a mutation.
STRIDE, RANDOM_SHARE, MOST_ATTEMPTS, LARGEST = 1_000_003, 0.8, 5, 1_000_000
#: How profits follow weights (with the odds of a random attempt), how weights are spread, and capacities.
PROFIT_CLASSES = ("uncorrelated", "weakly_correlated", "strongly_correlated", "subset_sum", "inverse_correlated")
PROFIT_ODDS = ("uncorrelated", "uncorrelated", "weakly_correlated", "weakly_correlated", "strongly_correlated", "subset_sum", "inverse_correlated")
WEIGHT_SHAPES = ("uniform", "small_heavy", "large_heavy", "mixed", "bimodal")
CAPACITIES = (20, 30, 50, 75, 100, 120, 150, 200, 250, 300, 500, 1000, 5000, 10000)

Instance = tuple[list[int], list[int], int]


def bounded(value: float) -> int:
    return int(min(max(round(float(value)), 1), LARGEST))


def log_uniform(rng: np.random.Generator, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def draw_profits(rng: np.random.Generator, weights: list[int], capacity: int, kind: str) -> list[int]:
    reach, top = max(capacity // 10, 10), max(capacity, 2)
    if kind == "weakly_correlated":
        return [max(1, int(w + rng.integers(-reach, reach + 1))) for w in weights]
    if kind == "strongly_correlated":
        step = int(rng.integers(1, reach + 1))
        return [w + step for w in weights]
    if kind == "subset_sum":
        return list(weights)
    if kind == "inverse_correlated":
        return [max(1, int(max(weights) - w + rng.integers(1, reach + 1))) for w in weights]
    return [int(rng.integers(1, top + 1)) for _ in weights]


def draw_weights(rng: np.random.Generator, n: int, capacity: int, shape: str) -> list[int]:
    below = lambda part: int(rng.integers(1, max(capacity // part, 2)))
    heavy = lambda: int(rng.integers(min(max(capacity // 2, 2), capacity), capacity + 1))
    one = {"uniform": lambda i: below(1), "small_heavy": lambda i: below(5), "large_heavy": lambda i: heavy(), "mixed": lambda i: below(4) if i < n // 2 else heavy(), "bimodal": lambda i: int(rng.choice([below(5), heavy()]))}[shape]
    return [max(1, one(i)) for i in range(n)]


def draw_instance(rng: np.random.Generator, n: int, capacity: int, shape_first: bool) -> tuple[Instance, dict]:
    """A random instance; the two callers of the draws differ in whether the weights' shape or the profits' class comes first."""
    if shape_first:
        shape = str(rng.choice(WEIGHT_SHAPES))
        w = draw_weights(rng, n, capacity, shape)
        kind = str(rng.choice(PROFIT_ODDS))
    else:
        kind, shape = str(rng.choice(PROFIT_ODDS)), str(rng.choice(WEIGHT_SHAPES))
        w = draw_weights(rng, n, capacity, shape)
    return (w, draw_profits(rng, w, capacity, kind), capacity), {"generated": "true", "n": n, "cap": capacity, "dist": shape, "corr": kind}


def _one_scaled(which: int, low: float, high: float):
    def op(x: Instance, rng: np.random.Generator):
        i = int(rng.integers(len(x[0])))
        out = (list(x[0]), list(x[1]), x[2])
        out[which][i] = bounded(out[which][i] * rng.uniform(low, high))
        return out, {"perturbed_index": i}

    return op


def _add(x: Instance, rng: np.random.Generator):
    top = max(x[2], 2)
    w = bounded(log_uniform(rng, 1, top))
    p = bounded(log_uniform(rng, 1, top))
    return (x[0] + [w], x[1] + [p], x[2]), {"added_weight": w, "added_profit": p}


def _delete(x: Instance, rng: np.random.Generator):
    if len(x[0]) <= 2:
        return None, {"reason": "minimum_size"}
    i = int(rng.integers(len(x[0])))
    return (x[0][:i] + x[0][i + 1 :], x[1][:i] + x[1][i + 1 :], x[2]), {"deleted_index": i}


def _capacity(x: Instance, rng: np.random.Generator):
    c = bounded(x[2] * rng.uniform(0.5, 2.0))
    return (x[0], x[1], c), {"new_capacity": c}


def _rescale(x: Instance, rng: np.random.Generator):
    f = log_uniform(rng, 0.3, 3.0)
    return ([bounded(w * f) for w in x[0]], [bounded(p * f) for p in x[1]], bounded(x[2] * f)), {"factor": f}


def _rank(x: Instance, rng: np.random.Generator):
    power, (low, high) = log_uniform(rng, 0.5, 3.0), (min(x[0]), max(x[0]))
    if low == high:
        return None, {"reason": "constant_weights"}
    rank = np.argsort(np.argsort(x[0], kind="stable"), kind="stable") / max(len(x[0]) - 1, 1)
    return ([bounded(low + (high - low) * float(r) ** power) for r in rank], x[1], x[2]), {"rank_power": power}


def _noise(x: Instance, rng: np.random.Generator):
    sigma = log_uniform(rng, 0.02, 0.6)
    return ([bounded(w * math.exp(rng.normal(0, sigma))) for w in x[0]], x[1], x[2]), {"noise_sigma": sigma}


def _flip(x: Instance, rng: np.random.Generator):
    kind = str(rng.choice(PROFIT_CLASSES))
    return (x[0], draw_profits(rng, x[0], x[2], kind), x[2]), {"corr_type": kind}


def _tie(x: Instance, rng: np.random.Generator):
    step = max(2, round(float(np.std(x[0])) * float(rng.uniform(0.1, 1.5))))
    return ([bounded(round(w / step) * step) for w in x[0]], x[1], x[2]), {"tie_step": step}


def _density(x: Instance, rng: np.random.Generator):
    i = int(rng.integers(len(x[0])))
    old = x[1][i] / max(x[0][i], 1)
    p = list(x[1])
    p[i] = bounded(old * rng.uniform(0.3, 3.0) * x[0][i])
    return (x[0], p, x[2]), {"perturbed_index": i, "old_density": old}


def _random(x: Instance, rng: np.random.Generator):
    n = int(rng.integers(3, 50))
    return draw_instance(rng, n, int(rng.choice(CAPACITIES)), shape_first=False)


#: The mutations in the order in which a draw picks them.
MUTATIONS = {
    "weight_perturb": _one_scaled(0, 0.5, 1.5), "profit_perturb": _one_scaled(1, 0.5, 1.5), "item_add": _add, "item_delete": _delete, "capacity_change": _capacity,
    "global_rescale": _rescale, "weight_rank": _rank, "weight_noise": _noise, "profit_correlation_flip": _flip, "tie_weight": _tie, "density_perturb": _density, "random_generate": _random,
}


def mutate(x: Instance, name: str, rng: np.random.Generator) -> tuple[Instance | None, dict]:
    """A changed copy and what was drawn; None if the mutation does not apply."""
    return MUTATIONS[name]((list(map(int, x[0])), list(map(int, x[1])), int(x[2])), rng)


def attempts(spark: SparkSession, parents: DataFrame | list[tuple[str, Instance]], many: int, seed: int) -> DataFrame:
    """(ord, operator, parent_id, parameters, weights, profit, capacity) of the attempts 1 to ``many`` that give an instance.

    An attempt draws the places of its parents among all of them, the parents at those
    places are joined to it, and the draws are repeated with them. So no list of parents
    is collected. ``parents``: (instance_id, ord, weights, profit, capacity), or a list.
    """
    if not isinstance(parents, DataFrame):
        parents = spark.createDataFrame([(k, i, *x) for k, (i, x) in enumerate(parents)], "ord long, instance_id string, weights array<bigint>, profit array<bigint>, capacity bigint")
    placed = numbered(parents.withColumn("canonical_hash", F.lit("")), position="__place").withColumn("__place", F.col("__place") - 1)
    count, names = placed.count(), list(MUTATIONS)
    if not count:
        raise ValueError("no parents")

    def draw(k: int) -> tuple[np.random.Generator, str, int, int, bool]:
        """(the generator after its first draws, operator, places of the parent and of the one that gives the capacity)."""
        rng = np.random.default_rng(int(seed + STRIDE * k))
        if rng.random() < RANDOM_SHARE:
            return rng, "random_generate", int(rng.choice(count)), int(rng.choice(count)), True
        op, place = names[int(rng.integers(len(names)))], int(rng.integers(count))
        return rng, op, place, place, False

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            drawn = [draw(int(k))[2:4] for k in f.id]
            yield pd.DataFrame({"id": f.id, "a": [x for x, _ in drawn], "b": [x for _, x in drawn]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, parent, w, p, c, other in zip(f.id, f.instance_id, f.weights, f.profit, f.capacity, f.other, strict=True):
                rng, op, _, _, random = draw(int(k))
                found, drawn = draw_instance(rng, len(w), int(other), shape_first=True) if random else mutate((w, p, c), op, rng)
                if found:
                    out.append((int(k), op, None if random else parent, {a: str(b) for a, b in drawn.items()}, *found))
            yield pd.DataFrame(out, columns=["ord", "operator", "parent_id", "parameters", "weights", "profit", "capacity"])

    tried = spark.range(1, many + 1).mapInPandas(places, "id long, a long, b long")
    first = placed.select(F.col("__place").alias("a"), "instance_id", "weights", "profit", "capacity")
    second = placed.select(F.col("__place").alias("b"), F.col("capacity").alias("other"))
    joined = tried.join(first, "a").join(second, "b").select("id", "instance_id", "weights", "profit", "capacity", "other")
    return joined.mapInPandas(run, "ord long, operator string, parent_id string, parameters map<string, string>, weights array<bigint>, profit array<bigint>, capacity bigint")


def finite_features(instances: DataFrame) -> DataFrame:
    """(ord): the instances whose features are all there and finite."""
    found = all_features(instances.withColumn("instance_id", F.col("ord")))
    values = F.array(*(F.col(c) for c in found.columns if c != "instance_id"))
    return found.where(F.forall(values, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))).select(F.col("instance_id").alias("ord"))


def generate(spark: SparkSession, parents: DataFrame | list[tuple[str, Instance]], target: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """Up to ``target`` accepted instances in the order of their attempts, numbered, with their lineage and hashes.

    Attempts that are valid and new count as known from then on; of these, those with a
    feature that is missing or not finite are left out before numbering.
    """
    tried = validated(attempts(spark, parents, MOST_ATTEMPTS * target, seed), "drop")
    new = stored(dedupe(tried, "ord", known).withColumn("canonical_hash", canonical_hash(generated=True)), "attempts")
    new = new.join(finite_features(new), "ord", "left_semi")
    fresh = numbered(new, "ord", "synthetic_KP_", 6).where(F.col("sequence") <= target)
    return fresh.select(
        F.col("numbered_id").alias("instance_id"), F.lit("synthetic").alias("origin"), F.lit("domain").alias("variant"), "weights", "profit", "capacity",
        F.coalesce("parent_id", F.lit("random")).alias("parent_instance_id"), "operator", F.col("parameters").alias("operator_parameters"), F.lit(0).alias("round"), (F.lit(seed) + F.lit(STRIDE) * F.col("ord")).alias("seed"), "sequence", "canonical_hash",
    )
