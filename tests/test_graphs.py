"""Graph features from the arc relation, against matrices."""

import random

import numpy as np
import pytest

from satchel.operators import graphs

SCHEMA = "graph string, i int, j int, cost double"


def random_arcs(seed, n, symmetric, values):
    rng = random.Random(seed)
    a = np.array([[rng.choice(values) for _ in range(n)] for _ in range(n)], dtype=float)
    return np.maximum(a, a.T) if symmetric else a


def relation(spark, matrices):
    return spark.createDataFrame([(g, i, j, float(a[i, j])) for g, a in matrices.items() for i in range(len(a)) for j in range(len(a)) if i != j], SCHEMA).repartition(3)


def prim(a):
    inside, out = {0}, []
    while len(inside) < len(a):
        cost, j = min((a[i, j], j) for i in inside for j in range(len(a)) if j not in inside)
        inside.add(j)
        out.append(cost)
    return out


@pytest.fixture(scope="module")
def symmetric():
    out = {f"g{k}": random_arcs(k, n, True, v) for k, (n, v) in enumerate([(4, [1, 2]), (9, range(50)), (12, [5]), (17, [1, 1, 1, 9]), (23, range(1000)), (6, [0]), (31, range(4))])}
    return out


def test_spanning_forests_of_all_graphs(spark, symmetric):
    got = {}
    for r in graphs.spanning_forest(relation(spark, symmetric)).collect():
        got.setdefault(r.graph, []).append((r.i, r.j, r.cost))
    for g, a in symmetric.items():
        edges = got[g]
        assert len(edges) == len(a) - 1 and all(a[i, j] == c for i, j, c in edges)
        assert sorted(c for *_, c in edges) == sorted(prim(a))
        parent = list(range(len(a)))  # the edges join all nodes
        for i, j, _ in edges:
            old, new = parent[i], parent[j]
            parent = [new if p == old else p for p in parent]
        assert len(set(parent)) == 1


def test_forest_of_a_graph_in_pieces(spark):
    rows = [("a", k, k + 1, 1.0) for k in range(40)] + [("a", 0, 5, 0.5), ("a", 5, 0, 0.25), ("a", 100, 101, 7.0), ("b", 7, 7, 1.0)]
    got = sorted(tuple(r) for r in graphs.spanning_forest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(got) == 41 and ("a", 0, 5, 0.25) in got and ("a", 100, 101, 7.0) in got  # of parallel arcs the cheaper
    assert graphs.spanning_forest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_symmetric_features(spark, symmetric):
    got = {r.graph: r for r in graphs.symmetric_features(relation(spark, symmetric)).collect()}
    assert set(got) == set(symmetric)
    for g, a in symmetric.items():
        n = len(a)
        r, edges = got[g], a[np.triu_indices(n, 1)]
        low = edges <= np.quantile(edges, 0.25)
        unit = max(edges.mean(), 1e-12)
        triples = [(i, j, k) for i in range(n) for j in range(n) for k in range(n) if len({i, j, k}) == 3]
        excess = np.array([a[i, k] - a[i, j] - a[j, k] for i, j, k in triples])
        assert r.triangle_violation_ratio == pytest.approx((excess > 0).mean())
        assert r.triangle_violation_mean_ratio == pytest.approx(excess[excess > 0].mean() / unit if (excess > 0).any() else 0)
        assert r.mst_weight_ratio == pytest.approx(sum(prim(a)) / ((n - 1) * unit))
        label = np.arange(n)
        for _ in range(n):
            for i, j in zip(*np.triu_indices(n, 1)):
                if a[i, j] <= np.quantile(edges, 0.25):
                    label[i] = label[j] = min(label[i], label[j])
        assert r.low_cost_component_ratio == pytest.approx(len(set(label)) / n) and r.low_cost_graph_density == pytest.approx(low.mean())
        off = a + np.diag([np.inf] * n)
        near = [(i, j) for i in range(n) for j in range(n) if off[i, j] == off[i].min()]
        assert r.nearest_reciprocity == pytest.approx(np.mean([off[i, j] == off[j].min() for i, j in near]))
        assert r.edge_tie_ratio == pytest.approx(1 - len(set(edges)) / len(edges)) and all(np.isfinite(v) for v in r[1:])


def test_directed_features(spark):
    made = {"ties": random_arcs(1, 5, False, [1, 2]), "wide": random_arcs(2, 13, False, range(900)), "flat": np.full((4, 4), 3.0), "zero": np.zeros((3, 3)), "same": random_arcs(3, 7, True, range(90))}
    got = {r.graph: r for r in graphs.directed_features(relation(spark, made)).collect()}
    assert set(got) == set(made)
    for g, a in made.items():
        n, r = len(a), got[g]
        off = ~np.eye(n, dtype=bool)
        x, y = a[off], a.T[off]
        m = x.mean()
        gap = np.abs(a - a.T)[np.triu_indices(n, 1)]
        two = np.sort(np.where(off, a, np.inf), 1)[:, :2]
        assert r.n == n and r.directed_cost_mean == pytest.approx(m) and r.directed_cost_cv == pytest.approx(x.std() / m if m else 0)
        assert r.directed_cost_kurtosis == pytest.approx(((x - m) ** 4).mean() / x.var() ** 2 - 3 if x.std() else 0)
        assert r.out_nearest_mean_ratio == pytest.approx(two[:, 0].mean() / m if m else 0)
        assert r.out_first_second_ratio == pytest.approx(np.mean([p / q if q else 1 for p, q in two]))
        assert r.reciprocal_abs_gap_mean_ratio == pytest.approx(gap.mean() / max(m, 1e-12)) and r.reciprocal_equal_ratio == pytest.approx((gap == 0).mean())
        assert r.reciprocal_cost_correlation == pytest.approx(np.corrcoef(x, y)[0, 1] if x.std() > 1e-12 else 1.0)


def test_faults(spark):
    a = random_arcs(4, 5, True, range(1, 9))
    rows = relation(spark, {"good": a, "small": np.ones((2, 2)), "three": np.ones((3, 3))})
    more = [("twice", i, j, 1.0) for i in range(4) for j in range(4) if i != j] + [("twice", 0, 1, 1.0)]
    more += [("bad", i, j, [1.0, -1.0, None, float("nan"), float("inf")][i + j]) for i in range(3) for j in range(3) if i != j]
    more += [("gap", 0, 1, 1.0), ("gap", 1, 2, 1.0), ("gap", 2, 0, 1.0), ("gap", 2, 2, 5.0)]
    more += [("one-way", i, j, float(i)) for i in range(4) for j in range(4) if i != j]
    rows = rows.unionByName(spark.createDataFrame(more, SCHEMA))
    assert {r.graph: r.reason for r in graphs.tour_faults(rows).collect()} == {
        "good": None, "three": None, "one-way": None, "small": "too_few_nodes", "twice": "costs_incomplete_or_repeated", "bad": "costs_not_finite_or_negative", "gap": "costs_incomplete_or_repeated",
    }
    assert {r.graph: r.reason for r in graphs.tour_faults(rows, True).collect()} | {"bad": 0} == {
        "good": None, "three": "too_few_nodes", "one-way": "not_symmetric", "small": "too_few_nodes", "twice": "costs_incomplete_or_repeated", "bad": 0, "gap": "too_few_nodes",
    }
    assert [r.graph for r in graphs.symmetric_features(rows).select("graph").collect()] == ["good"]


def test_path_features(spark):
    rows = [("p", 0, 1, 4.0), ("p", 0, 2, -2.0), ("p", 1, 0, 6.0), ("p", 3, 0, 0.0), ("p", 5, 5, 9.0), ("loop", 1, 1, 2.0), ("zero", 1, 2, 0.0)]
    nodes = spark.createDataFrame([("p", k) for k in range(5)], "graph string, i int")
    got = {r.graph: r for r in graphs.path_features(spark.createDataFrame(rows, SCHEMA), nodes).collect()}
    assert set(got) == {"p", "zero"}
    p, unit = got["p"], 3.0  # the mean absolute cost
    out, into = np.array([1.0, 6, 0, 0, 0]) / unit, np.array([3.0, 4, -2, 0, 0]) / unit
    assert p.sp_outgoing_mean_mean == pytest.approx(out.mean()) and p.sp_incoming_mean_q25 == pytest.approx(np.quantile(into, 0.25))
    assert p.sp_mean_cost_imbalance_std == pytest.approx(np.abs(out - into).std())
    assert p.sp_outgoing_minimum_gap_q50 == pytest.approx(2.0) and p.sp_incoming_minimum_gap_mean == pytest.approx(2.0)
    assert p.sp_reciprocal_cost_difference_q100 == pytest.approx(2 / unit) and p.sp_arc_density == 4 / 20 and p.sp_reciprocal_arc_fraction == 0.5
    assert (p.sp_no_outgoing_arc_node_fraction, p.sp_two_outgoing_arc_node_fraction, p.sp_no_incoming_arc_node_fraction, p.sp_two_incoming_arc_node_fraction) == (0.4, 0.2, 0.4, 0.2)
    assert got["zero"].sp_all_listed_costs_zero == 1 and got["zero"].sp_outgoing_mean_q100 == 0 and len(p) == 1 + 49
