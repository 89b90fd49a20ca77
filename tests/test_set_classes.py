"""Features of sets by classes of equal nodes, against the dense families."""

import importlib
import math
import random

import numpy as np
import pytest

from satchel.operators import families, set_classes

queries = importlib.import_module("__spark_entry__").queries()
SCHEMA = "graph string, member string, element int"


def dense(a):
    return families.incidence_counts({"incidence": {"__incidence_matrix__": a.tolist()}}) | families.bipartite({"incidence": {"__incidence_matrix__": a.tolist()}})


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(5)
    blocks = np.zeros((8, 30))
    blocks[:3, :12], blocks[3:7, 12:] = rng.random((3, 12)) < 0.7, rng.random((4, 18)) < 0.5  # the last set is empty
    blocks[0, :12], blocks[3, 12:] = 1, 1
    alike = np.repeat(np.repeat(rng.random((4, 5)) < 0.5, 3, 0), 7, 1).astype(float)
    alike[0] = 1
    wide, tall = (rng.random((6, 40)) < 0.4).astype(float), (rng.random((40, 6)) < 0.4).astype(float)
    wide[0] = tall[0] = 1
    return {"blocks": blocks, "alike": alike, "wide": wide, "tall": tall, "full": np.ones((5, 9)), "one": np.ones((1, 1)), "set": np.ones((1, 6)), "steps": np.tril(np.ones((7, 7)))}


@pytest.mark.parametrize("block", [3, 1024])
def test_against_dense(spark, matrices, block):
    links = [(g, f"m{i}" if i else None, int(j)) for g, a in matrices.items() for i, j in np.argwhere(a).tolist()] * 2
    links += [(g, f"m{i}" if i else None, None) for g, a in matrices.items() for i in range(len(a))] + [("none", "m", None)]
    random.Random(1).shuffle(links)
    got: dict = {}
    rows = set_classes.set_features(spark.createDataFrame(links, SCHEMA).repartition(3), block).collect()
    for r in rows:
        got.setdefault(r.graph, {})[r.feature] = r.value
    assert got.pop("none") == {"!Unsupported: empty_incidence_universe": None} and sum(r.graph == "none" for r in rows) == 2
    assert set(got) == set(matrices)
    for g, a in matrices.items():
        assert got[g] == pytest.approx(dense(a), abs=1e-9), g


def test_no_links(spark):
    assert set_classes.set_features(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("columns", "most"), [(8, 1 << 22), (64, 0)])
def test_pairs_of_blocks(monkeypatch, columns, most):
    monkeypatch.setattr(set_classes, "SLICE", columns)
    monkeypatch.setattr(set_classes, "IN_PLACE", most)
    rng = np.random.default_rng(2)
    weight, blocks = rng.integers(1, 5, 21), []
    for n in (6, 4):
        bits, times = rng.random((n, 21)) < 0.6, rng.integers(1, 9, n)
        bits[:, 0] = True
        blocks.append((bits, times, {"bits": np.packbits(bits, axis=1).tobytes(), "times": times.tobytes(), "weights": weight.tobytes()}))
    for one, two, same in ((blocks[0], blocks[1], False), (blocks[0], blocks[0], True)):
        want: dict = {}
        for i, a in enumerate(one[0]):
            for j, b in enumerate(two[0]):
                if i < j or not same:
                    t = int(one[1][i] * two[1][j])
                    s, x, y = (int(weight[m].sum()) for m in (a & b, a, b))
                    many, inside = want.get((s, x + y - s), (0, 0))
                    want[s, x + y - s] = many + t, inside + t * (s == min(x, y) and x != y)
        got = set_classes.block_pairs(one[2], two[2], same)
        assert {(s, u): (t, i) for s, u, t, i in zip(*(x.tolist() for x in got), strict=True)} == want


def test_spread_of_counted_values():
    x, times = np.array([0.5, 0.1, 1.0, 0.2]), np.array([3, 4, 1, 0])
    wide = (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)
    assert set_classes.counted_spread("x", x, times, wide) == pytest.approx(families.spread("x", np.repeat(x, times), wide))
    assert set(set_classes.counted_spread("x", x[:0], times[:0], wide).values()) == {0.0}


def test_small_singular_values_are_kept(spark):
    """Eigenvalues of a Gram matrix would give about 1e-8 for the second value, which is 0."""
    links = spark.range(700).selectExpr("'g' AS graph", "CAST(id % 7 AS STRING) AS member", "CAST(id div 7 AS INT) AS element")
    got = {r.feature: r.value for r in set_classes.set_features(links).collect()}
    assert got["graph_normalized_second_singular_value"] < 1e-12 and got["graph_normalized_spectral_gap"] == pytest.approx(1)


def test_a_nation_of_many_suppliers(spark, tmp_path):
    """20,000 suppliers of one nation: an array of all their pairs would take 3.2 GB."""
    n = 20_000
    spark.range(4).selectExpr("id AS p_partkey", "'B' || id AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).selectExpr("id AS s_suppkey", "3 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    # of four suppliers, one has the brands 0 and 1, one 0 and 2, two 0 and 3
    spark.range(2 * n).selectExpr("id div 2 AS l_suppkey", "IF(id % 2 = 0, 0, LEAST(3, 1 + id div 2 % 4)) AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.feature: r.value for r in queries["incidence_features"](spark, str(tmp_path)).collect()}
    kinds = np.array([n // 4, n // 4, n // 2])
    same, pairs = int((kinds * (kinds - 1) // 2).sum()), n * (n - 1) // 2
    assert got["incidence_universe_size"] == n and got["incidence_density"] == 0.5 and got["element_degree_mean"] == 2
    assert got["graph_component_count"] == 1 and got["graph_leaf_node_ratio"] == 0
    of_sets = [0.25, 0.25, 0.5, 0, 0, 0]
    assert got["graph_neighbor_jaccard_mean"] == pytest.approx((same + (pairs - same) / 3 + sum(of_sets)) / (pairs + 6), rel=1e-6)
    assert got["graph_identical_nonempty_neighborhood_pair_ratio"] == pytest.approx(same / (pairs + 6), rel=1e-6)
    assert got["graph_strict_nonempty_containment_pair_ratio"] == pytest.approx(3 / (pairs + 6), rel=1e-6)
    assert got["graph_normalized_second_singular_value"] == pytest.approx(math.sqrt(0.5), rel=1e-6)
