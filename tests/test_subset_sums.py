"""Subset-sum features against every subset."""

import itertools
import math
import random

import numpy as np
import pytest

from satchel.operators import subset_sums

SCHEMA = "instance_id string, sizes array<bigint>, capacity bigint"


def brute(sizes, capacity):
    unit = math.gcd(capacity, *sizes)
    sizes, capacity, n = [s // unit for s in sizes], capacity // unit, len(sizes)
    subsets = [(sum(c), len(c)) for k in range(1, n + 1) for c in itertools.combinations(sizes, k) if sum(c) <= capacity]
    x, k = np.array(subsets, dtype=float).T
    small, large = (sum(sum(order[: i + 1]) <= capacity for i in range(n)) for order in (sorted(sizes), sorted(sizes)[::-1]))
    return [small, small / n, large, large / n, len(x) / (2**n - 1), (x == capacity).mean(), x.mean() / capacity, x.std() / capacity, k.mean() / n, k.std() / n, len(set(x)) / capacity, x.max() / capacity]


def test_against_all_subsets(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        sizes = [rng.randrange(1, 20) * rng.choice([1, 6]) for _ in range(rng.randrange(1, 11))]
        rows.append((f"i{k}", sizes, max(sizes) + rng.randrange(60)))
    rows += [("one", [7], 7), ("same", [4, 4, 4], 8)]
    got = {r[0]: list(r[1:]) for r in subset_sums.subset_sum_features(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == {r[0] for r in rows}
    for name, sizes, capacity in rows:
        assert got[name] == pytest.approx(brute(sizes, capacity), abs=1e-9), (sizes, capacity)


def test_faults_give_no_row(spark):
    rows = [("good", [1, 2], 2), ("none", None, 3), ("empty", [], 3), ("null", [1, None], 3), ("zero", [0, 1], 3), ("large", [9], 3), ("flat", [1], 0), ("open", [1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[0] for r in subset_sums.subset_sum_features(df).collect()] == ["good"]
    reasons = {r[0]: r[1] for r in df.select("instance_id", subset_sums.faults(df.sizes, df.capacity)).collect()}
    assert reasons.pop("good") is None and {k for k, v in reasons.items() if v == "item_without_size_or_too_large"} == {"null", "zero", "large"}
    assert subset_sums.subset_sum_features(df.limit(0)).count() == 0


def test_counts_pass_64_bits_and_overflow_raises(spark, monkeypatch):
    n = 66
    states = subset_sums.load_states(spark.createDataFrame([("ones", [1] * n, n)], SCHEMA)).collect()
    assert {r.load: int(r.ways) for r in states} == {k: math.comb(n, k) for k in range(n + 1)}
    assert all(int(r.squares) == k * k * math.comb(n, k) for r in states for k in [r.load])
    monkeypatch.setattr(subset_sums, "NUMBER", "decimal(6,0)")  # as 38 digits after 126 items
    with pytest.raises(Exception, match="(?i)overflow|NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        subset_sums.load_states(spark.createDataFrame([("many", [1] * 25, 25)], SCHEMA)).collect()


def test_tasks_and_relation_agree(spark, monkeypatch):
    """Small instances make no relation of loads; those beyond its bounds do, with the same features."""
    rng = random.Random(3)
    rows = [(f"i{k}", [rng.randrange(1, 50) for _ in range(rng.randrange(1, 14))], 50 + rng.randrange(200)) for k in range(60)]
    df = spark.createDataFrame([*rows, ("long", [3] * 45, 100), ("wide", [10**15, 10**15 + 1, 7], 2 * 10**15)], SCHEMA)
    made, states = [], subset_sums.load_states
    monkeypatch.setattr(subset_sums, "load_states", lambda d: made.append(d.count()) or states(d))
    monkeypatch.setattr(subset_sums, "AT_ONCE", 1000)
    in_tasks = {r[0]: list(r[1:]) for r in subset_sums.subset_sum_features(df).collect()}
    assert made == [1]  # the wide one
    monkeypatch.setattr(subset_sums, "MOST_ITEMS", 0)
    by_relation = {r[0]: list(r[1:]) for r in subset_sums.subset_sum_features(df).collect()}
    assert made == [1, 62] and set(in_tasks) == set(by_relation) and all(in_tasks[k] == pytest.approx(by_relation[k], rel=1e-9) for k in in_tasks)
