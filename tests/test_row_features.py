"""Features as expressions of a row, against the same features from arrays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from satchel.operators import compatibility, families, features, packing, quadratic


def rows_of(df):
    return {r[0]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def bins(spark):
    rng = random.Random(4)
    out = []
    for k in range(40):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 14))]
        out.append((f"i{k}", sizes, max(sizes) + rng.choice([0, 5, 40])))
    out += [("one", [3], 3), ("same", [2] * 6, 4), ("pair", [3, 5], 8)]
    return out, spark.createDataFrame(out, "instance_id string, sizes array<bigint>, capacity bigint").repartition(3)


@pytest.mark.parametrize(("new", "old"), [(compatibility.compatibility_features, families.compatibility), (packing.packing_features, families.packing)])
def test_bins(bins, new, old):
    got = rows_of(new(bins[1]))
    assert set(got) == {name for name, *_ in bins[0]}
    for name, sizes, capacity in bins[0]:
        want = old({"sizes": sizes, "capacity": capacity})
        assert {k: v for k, v in got[name].items() if k != "instance_id"} == {k: pytest.approx(v, abs=1e-7) for k, v in want.items()}, sizes


def test_bins_without_features(spark):
    rows = [("none", None, 3), ("empty", [], 3), ("flat", [1, 2], 0), ("open", [1, 2], None)]
    df = spark.createDataFrame(rows, "instance_id string, sizes array<bigint>, capacity bigint")
    assert compatibility.compatibility_features(df).count() == 0 and packing.packing_features(df).count() == 0
    wide = spark.createDataFrame([("null", [1, None], 3), ("large", [4], 3), ("zero", [0, 1], 3)], df.schema)
    assert packing.packing_features(wide).count() == 0 and packing.packing_features(df.limit(0)).count() == 0


def test_quadratic(spark):
    rng, made = random.Random(6), {}
    for k in range(40):
        n = rng.randrange(1, 12)
        pairs = {(i, j): rng.choice([0, 1, 5, 90, 91]) for i in range(n) for j in range(n) if rng.random() < 0.7}
        made[f"i{k}"] = {"weights": [rng.randrange(1, 30) for _ in range(n)], "profits": [rng.randrange(50) for _ in range(n)], "capacity": rng.randrange(1, 120), "pair_profit": pairs}
    made["ring"] = {"weights": [1, 2, 3, 4], "profits": [0] * 4, "capacity": 6, "pair_profit": {(0, 1): 9, (1, 2): 9, (0, 2): 9, (2, 3): 1, (1, 3): 1, (0, 3): 1, (3, 0): 99}}
    rows = [(k, json.dumps({"w": d["weights"], "p": d["profits"], "c": d["capacity"], "q": [{"i": i, "j": j, "v": v} for (i, j), v in d["pair_profit"].items()]})) for k, d in made.items()]
    parsed = spark.createDataFrame(rows, "instance_id string, text string").withColumn("d", F.from_json("text", "w array<bigint>, p array<bigint>, c bigint, q array<struct<i: int, j: int, v: bigint>>"))
    got = rows_of(quadratic.quadratic_features(parsed.select("instance_id", F.col("d.w").alias("weights"), F.col("d.p").alias("profit"), F.col("d.c").alias("capacity"), F.col("d.q").alias("pair_profit"))))
    assert set(got) == set(made) and got["ring"]["high_pair_triangle_ratio"] == 0.25
    for name, d in made.items():
        assert {k: v for k, v in got[name].items() if k != "instance_id"} == {k: pytest.approx(v, abs=1e-7) for k, v in families.quadratic(d).items()}, d


def test_chosen_features_take_only_their_steps(spark, monkeypatch):
    rows = spark.createDataFrame([(f"i{k}", [k + 1, 2, 5 + k], [3, 4 * k, 1], 4 + k) for k in range(6)], "instance_id string, weights array<long>, profit array<long>, capacity long")
    names = ["kp_weight_gini", "weights_cv", "capacity_total_weight_ratio", "profit_cv"]
    whole = features.all_features(rows)
    assert set(whole.columns) == {"instance_id", *features.DOMAIN, *features.RELATION} and all(None not in r for r in whole.collect())
    want = {tuple(r) for r in whole.select("instance_id", *names).collect()}

    def refuse(*_):
        raise AssertionError("pairs are not asked for")

    monkeypatch.setattr(features, "STEPS", [(begins, refuse if "kp_pair_" in begins else step) for begins, step in features.STEPS])
    assert {tuple(r) for r in features.chosen_features(rows, names).collect()} == want and len(want) == 6
