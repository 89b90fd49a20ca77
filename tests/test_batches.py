"""Features computed on Arrow batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.functions import batches
from satchel.functions.arrays import STATS, TIE_BREAK, with_stats
from satchel.operators import compatibility, features, hashing, text

SCHEMA = "instance_id string, weights array<bigint>, profit array<bigint>, capacity bigint"


@pytest.fixture(scope="module")
def mixed(spark):
    """Lengths 1 to 9 in one batch, ties, profits of 0, capacities below every weight."""
    rng = random.Random(3)
    rows = [(f"i{k}", *([rng.randrange(low, 9) for _ in range(1 + k % 9)] for low in (1, 0)), rng.randrange(1, 40)) for k in range(300)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_statistics_are_those_of_the_expressions(mixed):
    want = {r.instance_id: r for r in with_stats(mixed, "weights", F.col("weights")).collect()}
    for r in features.all_features(mixed).collect():
        for s in STATS:
            assert r[f"weights_{s}"] == pytest.approx(want[r.instance_id][f"weights_{s}"], abs=1e-12)


def test_rounding_is_exact(spark):
    """50 / 307 lies near the middle of two results: Spark's format rounds the shortest digits up, SQL the number itself down."""
    rng = np.random.default_rng(2)
    x = np.concatenate([[50 / 307, 0.0, -0.0, 1e-10, 9999999.5, 0.99999995, 1e300, -1e25, np.nan, np.inf], rng.normal(size=2000) * 10.0 ** rng.integers(-8, 28, 2000)])
    got = [r[0] for r in batches.rounded(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").coalesce(1)).collect()]
    assert got[-1] is None and math.isnan(got[8]) and got[9] == math.inf and got[0] == 0.1628664
    for v, r in zip(x.tolist(), got, strict=False):
        assert math.isnan(v) or r == (0.0 if abs(v) < 1e-9 else float(f"{v * TIE_BREAK:.6e}"))


def test_rows_without_features(spark):
    rows = [("null", None, [1], 3), ("hole", [1, None], [1, 2], 3), ("open", [1], [1], None), ("ragged", [1, 2], [1], 3), ("good", [1, 2], [3, 4], 3)]
    got = {r.instance_id: r for r in features.all_features(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert {k for k, r in got.items() if r.kp_weight_gini is None} == {"null", "hole", "open", "ragged"} and got["good"].weights_mean == 1.5


def test_means(spark, mixed):
    found = features.all_features(mixed)
    got = {r.feature: r for r in features.feature_means(found).collect()}
    want = found.agg(*(F.avg(c).alias(c) for c in found.columns[1:])).head()
    assert len(got) == 100 and all(r.rows == 300 and r.not_finite == 0 and r["mean"] == pytest.approx(want[f]) for f, r in got.items())
    odd = spark.createDataFrame([(1.0,), (None,), (float("inf"),)], "x double")
    assert features.feature_means(odd).head().asDict() == {"feature": "x", "rows": 3, "mean": math.inf, "not_finite": 1}
    assert features.feature_means(odd.limit(0)).count() == 0


def test_bins_of_all_lengths_in_one_batch(spark):
    """A bin of 40 sizes beside others of 1 to 3: matrices are cut, rows keep their places; a null size gives nulls, not a null array's size."""
    rows = [(f"i{k}", [1 + (k + j) % 7 for j in range(40 if k == 5 else 1 + k % 3)], 9) for k in range(30)] + [("hole", [1, None], 9)]
    df = spark.createDataFrame(rows, "instance_id string, sizes array<bigint>, capacity bigint")
    together, apart = ({r[0]: r for r in compatibility.compatibility_features(x).collect()} for x in (df.coalesce(1), df.repartition(31)))
    assert together == apart and len(together) == 31 and set(together["hole"][1:]) == {None}
    assert compatibility._triples(4)[0].tolist() == [0, 0, 0, 1] and compatibility._triples(2)[2].size == 0


def test_first_of_a_class(spark):
    """Multiples, values of 0, numbers of one length; a row without lists or order is left out."""
    rows = [(3, [2, 4], [6, 0], 8), (1, [1, 2], [3, 0], 4), (2, [1, 2], [3, 0], 5), (4, [7], [0], 14), (5, [1], [0], 2), (6, None, [1], 1), (None, [5], [5], 5)]
    df = spark.createDataFrame(rows, "ord long, weights array<bigint>, profit array<bigint>, capacity bigint")
    assert sorted(r.ord for r in hashing.dedupe(df).collect()) == [1, 2, 4]
    key = {r.ord: r.k for r in df.select("ord", hashing.proportional_key().alias("k")).coalesce(1).collect()}
    assert key[1] == key[3] == hashing.hashlib.sha256(b"1,2,3,0,4").hexdigest() and key[6] is None
    assert "Join" not in hashing.dedupe(df)._jdf.queryExecution().optimizedPlan().toString()


def test_rendered_forms_are_found_in_any_text(spark):
    """Plain texts are searched in lower case and once, others as before: line breaks, order, thousands, other digits' neighbours."""
    body = "3. ITEM 2 :\n Value = 1,200 x, WEIGHT = 7\nProject 1: value=5.\n Weight = 6\nfood 0 Value = 9 Weight= 8\nItem 5: Value = 4\nWeight = 4\nA Capacity\nof 1,050"
    texts = {"plain": body, "accent": body + " \u00e9", "mark": body + " \x01", "none": "Item: Value = 3, Weight = 2", "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "instance_id string, question string").coalesce(1)
    got = {r.instance_id: tuple(r[1:]) for r in text.parse_rendered(df).collect()}
    assert got["plain"] == got["accent"] == got["mark"] == ([8, 7], [9, 1200], 1050)
    assert got["none"] == got["empty"] == ([], [], None)
    assert "__lowered" not in text.render(spark.createDataFrame([([1], [2], 3)], "weights array<bigint>, profit array<bigint>, capacity bigint")).columns
