import hashlib
import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from satchel.operators import augment, families, features, hashing, shape, solve, text
from satchel.plans import projection
from satchel.sources import tables

SAMPLE = ([4651, 1335, 1428, 4755, 2930], [581, 832, 245, 858, 382], 10569)
KP = "instance_id string, ord long, weights array<bigint>, profit array<bigint>, capacity bigint"


def frame(spark, rows):
    return spark.createDataFrame([(f"i{k}", k, *r) for k, r in enumerate(rows)], KP)


EDGES = [SAMPLE, ([5, 5], [0, 0], 3), ([1, 2, 3], [1, 1, 1], 100), ([7, 7, 7], [3, 4, 5], 7), ([10, 20], [1, 2], 10), (list(range(1, 41)), list(range(40, 0, -1)), 300)]


def numpy_stats(x):
    x = np.asarray(x, float)
    m, d = x.mean(), x.std()
    z = (x - m) / d if d > 1e-12 else x * 0
    return [len(x), m, d * d, d, x.min(), x.max(), *np.quantile(x, [0.25, 0.5, 0.75]), (x == 0).mean(), (x < 0).mean(), len(np.unique(x)) / len(x), d / abs(m) if abs(m) > 1e-12 else 0, (z**3).mean(), (z**4).mean() - 3 if d > 1e-12 else 0]


def test_domain_features(spark):
    rows = {r.instance_id: r for r in features.domain_features(frame(spark, EDGES)).collect()}
    for k, (w, p, c) in enumerate(EDGES):
        ratio = np.array(p) / np.array(w)
        want = [*numpy_stats(w), *numpy_stats(p), *numpy_stats([c]), c / sum(w), *numpy_stats(ratio)]
        assert np.allclose([rows[f"i{k}"][n] for n in features.DOMAIN], want, atol=1e-9)
    assert len(features.DOMAIN) == 61 and len(features.RELATION) == 39


def test_relation_features(spark):
    rows = {r.instance_id: r for r in features.relation_features(frame(spark, EDGES)).collect()}
    for k, (w, p, c) in enumerate(EDGES):
        w, p = np.array(w, float), np.array(p, float)
        i, j = np.triu_indices(len(w), 1)
        s, r = 1 - w[i] / c - w[j] / c, rows[f"i{k}"]
        assert math.isclose(r.kp_pair_slack_mean, s.mean(), abs_tol=1e-9) and math.isclose(r.kp_pair_fit_ratio, (s >= -1e-12).mean(), abs_tol=1e-9)
        assert math.isclose(r.kp_weight_gini, np.abs(w[:, None] - w).sum() / (2 * len(w) * w.sum()), abs_tol=1e-9)
        want = 0 if np.ptp(w) == 0 or np.ptp(p) == 0 else np.corrcoef(w, p)[0, 1]
        assert math.isclose(r.kp_weight_profit_pearson, want, abs_tol=1e-9)
        assert r.kp_weight_profit_correlation_undefined == float(np.ptp(w) == 0 or np.ptp(p) == 0)


def test_hashes(spark):
    w, p, c = SAMPLE
    body = {"problem": "KP", "proportional": False, "n_items": 5, "weights_profits_capacity": [format(float(v), ".15g") for v in [*w, *p, c]]}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    row = hashing.with_proportional_hash(hashing.with_hashes(frame(spark, [SAMPLE]))).head()
    assert row.canonical_hash == want == hashing.instance_hash(w, p, c) and row.proportional_hash == hashing.instance_hash(w, p, c, True)


def test_dedupe_of_scaled_and_permuted_copies(spark):
    w, p, c = SAMPLE
    rows = [SAMPLE, ([3 * v for v in w], [3 * v for v in p], 3 * c), (w[::-1], p[::-1], c), SAMPLE]
    assert [r.ord for r in hashing.dedupe(frame(spark, rows)).orderBy("ord").collect()] == [0, 2]
    numbered = hashing.numbered(hashing.dedupe(frame(spark, rows))).orderBy("ord").collect()
    assert [r.sequence for r in numbered] == [1, 2] and numbered[0].numbered_id == f"sage_original_KP_0001_{hashing.instance_hash(w, p, c)[:10]}"
    assert hashing.dedupe(frame(spark, rows), parents=frame(spark, [SAMPLE])).count() == 1


def test_validation(spark):
    bad = [([1], [1], 1), ([0, 1], [1, 1], 1), ([1, 1], [-1, 1], 1), ([1, 1], [1, 1], 0), ([1, 1], [1], 5), (None, [1, 1], 5)]
    rows = hashing.validated(frame(spark, bad)).orderBy("ord").collect()
    assert [r.reasons[0] for r in rows] == ["item_count", "nonpositive_weight", "negative_profit", "nonpositive_capacity", "length_mismatch", "missing_field"]
    assert hashing.validated(frame(spark, [*bad, SAMPLE]), "drop").count() == 1
    with pytest.raises(Exception, match="item_count"):
        hashing.validated(frame(spark, bad[:1]), "fail").collect()


def test_render_and_parse(spark):
    rows = text.render(frame(spark, EDGES))
    for parsed in (text.parse_rendered(rows), text.parse_questions(rows)):
        got = {r.instance_id: (list(r.weights), list(r.profit), r.capacity) for r in parsed.collect()}
        assert got == {f"i{k}": x for k, x in enumerate(EDGES)}


FORMS = {
    "Item 0: Weight = 3, Value = 10\nItem 1: Weight = 4, Value = 1,200": [(3, 10), (4, 1200)],
    "Item B has a value of 7 and weighs 2\nItem A has a value of 9 and weighs 1": [(1, 9), (2, 7)],
    "item_1 (value: 5, weight: 6)\nitem_2 (value: 7, weight: 8)": [(6, 5), (8, 7)],
    "`item_2`: Value = 3, Weight = 4\n`item_1`: Value = 1, Weight = 2": [(2, 1), (4, 3)],
    "Package 1: Valued at 30 and weighing 4 kg\nPackage 2: Valued at 40, weighs 5": [(4, 30), (5, 40)],
    "Package 1: Valued at $30 and weighing 4 kg\nPackage 2: Valued at $40, weighs 5": [],
    "Item 1 has an educational value of 5 and costs 2\nItem 2 has an utility of 6 and weight of 3": [(2, 5), (3, 6)],
    "item_1 (value = 10, weight = 5)\n`item_2` ( value 4, at weight 6 )": [(5, 10), (6, 4)],
    "Item 0: Provides a value of 8 and adds a workload of 3\nItem 1: Contributes an educational value of 9, with a weight of 4\nItem 2: Has a performance of 7 and costs 1": [(3, 8), (4, 9), (1, 7)],
    "Item A:\n- Value: $5\n- Weight: 1\nItem B:\n* Value: $6\n* Weight: 2": [(1, 5), (2, 6)],
    "Revenue (in $):\nItem 0: $336\nItem 1: $40\nWeight:\nItem 0: 46 kg\nItem 1: 5\nItem 2: 6\nObjective: most": [(46, 336), (5, 40)],
    "Item 0: 5 units of value\nItem 1: 6 units of value\nItem 0: 1 units of weight\nItem 1: 2 units of weight": [(1, 5), (2, 6)],
    "| Item | Size | Weight | Utility | Value |\n|---|---|---|---|---|\n| a | 9 | 2 | 8 | 10 |\n| b | 9 | 3 | 8 | 11 |": [(2, 10), (3, 11)],
    "| Weight | Item | Revenue |\n|:-|-|-:|\n| 2 | a | 10 |\n| 3 | b | 11 |": [(2, 10), (3, 11)],
    "| Item | Value | Weight |\n|---|---|---|\n| a | 10 | 2 |": [],
    "A thing has a value of 5 and a weight of 3, another has a value of 6 and a weight of 4.": [],
    "Values:\nItem 1: 10\nItem 2: 20\n\nWeights:\nItem 1: 3\nItem 2: 4\n": [(3, 10), (4, 20)],
    "| Item | Value | Weight |\n|---|---|---|\n| a | 10 | 2 |\n| b | 1,000 | 3 |\nend": [(2, 10), (3, 1000)],
    "| Plan | Cost | Capacity increase |\n|---|---|---|\n| a | 10 | 2 |\n| b | 20 | 3 |\n": [(10, 2), (20, 3)],
}


@pytest.mark.parametrize("written", FORMS)
def test_written_forms(written):
    assert text.parse_items(written) == FORMS[written]


def test_forms_are_tried_where_their_words_are(monkeypatch):
    """A form is searched only in texts with its literal parts; in any case, and beyond ASCII, the result is that of all forms."""
    for said, want in FORMS.items():
        for other in (said.upper(), "caf\u00e9\n" + said, said.lower()):
            assert text.parse_items(other) == want
    for (_, pattern), needed in zip(text.FORMS, text.NEEDED, strict=True):
        assert any(text.compiled(pattern, True).search(said.lower()) for said in [*FORMS, *NOT_IN_FORMS]), pattern
        assert all(all(x in said.lower() for x in needed) for said in [*FORMS, *NOT_IN_FORMS] if text.compiled(pattern, False).search(said)), pattern
    tried, search = [], text.from_form
    monkeypatch.setattr(text, "from_form", lambda *a: tried.append(a) or search(*a))
    assert text.parse_items("| Item | Value | Weight |\n|---|---|---|\n| a | 10 | 2 |\n| b | 7 | 3 |\n") == [(2, 10), (3, 7)]
    assert len(tried) <= 1  # before: all 16


NOT_IN_FORMS = [
    "Item 1: Value = 3, Weight = 4", "item_1 has a value of 5 units and weighs 2", "item_1 is valued at 5 and weighs 2", "Item 1: Valued at 5 units, with a cost of 2", "Item 1: Utility of 5, weight of 2",
    "Item 1 has a value of 5 and a cost of 2", "Item 1 has a value of 5 and a weight of 2", "Item 1 with a value of 5 and weight of 2", "Item 1: Valued at 5 units with a weight of 2",
]


def test_capacity_phrases(spark):
    said = ["a weight capacity of 1,500 kg", "must not exceed 40 units", "budget of 12 million yuan", "weight limit for it is 9 kg", "none"]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(text.capacity_of(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [1500, 40, 12, 9, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 40)), min_size=2, max_size=9), st.integers(1, 90))
def test_optimum(items, capacity):
    w, p = [a for a, _ in items], [b for _, b in items]
    best = max(sum(p[i] for i in s) for k in range(len(w) + 1) for s in itertools.combinations(range(len(w)), k) if sum(w[i] for i in s) <= capacity)
    value, chosen = solve.optimum(w, p, capacity)
    assert value == best == sum(p[i] for i in chosen) and sum(w[i] for i in chosen) <= capacity
    cells, solve.MOST_CELLS = solve.MOST_CELLS, 0
    try:
        value, chosen = solve.optimum(w, p, capacity)
    finally:
        solve.MOST_CELLS = cells
    assert value == best == sum(p[i] for i in chosen) and sum(w[i] for i in chosen) <= capacity
    assert solve.by_flow(w, p, capacity) == solve.by_patterns(w, p, capacity)[0] == solve.by_qubo(w, p, capacity) == best


def test_patterns_beyond_the_list_count(spark):
    rng = random.Random(5)
    rows = [([1] * 18, list(range(1, 19)), 9)] + [([rng.randrange(1, 51) for _ in range(n)], [rng.randrange(900, 90_000) for _ in range(n)], 12 * n) for n in (20, 22, 25)]
    for w, p, c in rows:
        assert solve.by_patterns(w, p, c) == (solve.optimum(w, p, c)[0], True)
    assert solve.best_pattern([1, 2], [-3, -2], 1) == -3 and solve.best_pattern([5], [1], 4) == 0 and solve.best_pattern([1] * 15, [2**62] * 15, 2) == 2**63
    got = solve.wide(solve.run_formulations(frame(spark, rows)), "objective").collect()
    assert all(r.pattern_selection == r.compact for r in got)


def test_slack_bits_reach_every_value():
    for c in (1, 2, 3, 7, 8, 100):
        bits = solve.slack_bits(c)
        assert {sum(s) for k in range(len(bits) + 1) for s in itertools.combinations(bits, k)} == set(range(c + 1))


def test_formulation_gates(spark):
    big = ([1] * 60, [1] * 60, 6000)
    rows = {r.instance_id: r for r in solve.gates(frame(spark, [SAMPLE, big])).collect()}
    assert (rows["i0"].arc_flow, rows["i0"].qubo) == (False, False) and rows["i1"].compact and not rows["i1"].pattern_selection


def test_solution_checks(spark):
    row = ("kp_compact_v1", 3, [5, 6, 7], [1, 2, 3], 11, {"x_0": 1.0, "x_1": 0.9, "x_2": 0.2, "b_0": 1.0}, {"x_0": 1.0, "x_1": 2.5, "x_7": 1.0})
    out = spark.createDataFrame([row], "formulation_id string, n int, weights array<bigint>, profit array<bigint>, capacity bigint, variables map<string, double>, objective_linear map<string, double>")
    got = solve.objective_errors(solve.signature_errors(out)).withColumn("s", solve.selected_items(F.col("variables"))).withColumn("f", solve.feasibility_errors(F.col("weights"), F.lit(10), F.col("s"))).head()
    assert got.signature_errors == ["forbidden_b"] and got.objective_errors == ["item_out_of_range"] and list(got.s) == [0, 1] and got.f == ["over_capacity"]


def test_generation_is_reproducible(spark):
    parents = [("a", SAMPLE), ("b", ([3, 4], [5, 6], 5))]
    one, two = (augment.generate(spark, parents, 20, 7).orderBy("sequence").collect() for _ in "ab")
    assert one == two and [r.sequence for r in one] == list(range(1, 21))
    for r in one:
        assert r.canonical_hash == hashing.instance_hash(list(r.weights), list(r.profit), r.capacity, generated=True) and r.instance_id.endswith(r.canonical_hash[:10])


@pytest.mark.parametrize("name", augment.MUTATIONS)
def test_mutations_keep_instances_valid(name):
    for seed in range(20):
        got, _ = augment.mutate(SAMPLE, name, np.random.default_rng(seed))
        assert got is None or (len(got[0]) == len(got[1]) >= 2 and min(got[0]) > 0 and min(got[1]) >= 0 and got[2] > 0)
    assert augment.mutate(([5, 5], [1, 2], 3), "weight_rank", np.random.default_rng(0))[0] is None
    assert augment.mutate(([5, 5], [1, 2], 3), "item_delete", np.random.default_rng(0))[0] is None


def test_packing_families():
    d = {"sizes": [5, 5, 2], "capacity": 10}
    got = families.compatibility(d) | families.packing(d) | families.subset_sums(d)
    assert got["compat_pair_fit_ratio"] == 1 and math.isclose(got["compat_pair_exact_fit_ratio"], 1 / 3) and got["compat_triple_fit_ratio"] == 0
    assert got["remaining_capacity_fraction"] == pytest.approx(0.8) and got["subset_feasible_fraction"] == pytest.approx(6 / 7) and got["subset_maximum_load_ratio"] == 1
    with pytest.raises(families.Unsupported):
        families.packing({"sizes": [11], "capacity": 10})


def test_tour_families():
    rng = np.random.default_rng(1)
    z = rng.random((6, 2))
    cost = np.linalg.norm(z[:, None] - z, axis=2)
    got = families.symmetric_tour({"n": 6, "cost": cost.tolist()})
    assert got["triangle_violation_ratio"] == pytest.approx(0, abs=1e-12) or got["triangle_violation_mean_ratio"] < 1e-9
    assert len(got) == 22 and len(families.directed_tour({"n": 6, "cost": cost.tolist()})) == 25
    with pytest.raises(families.Unsupported):
        families.symmetric_tour({"n": 4, "cost": [[0, 1, 1, 1], [2, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 0]]})


def test_incidence_and_paths():
    got = families.bipartite({"incidence": [[1, 2], [1, 2], [3]]})
    assert got["graph_component_count"] == 2 and got["graph_largest_component_node_ratio"] == pytest.approx(4 / 6)
    arcs = families.shortest_path({"nodes": [0, 1, 2], "arc_cost": {(0, 1): 2.0, (1, 0): 4.0, (0, 2): 6.0}})
    assert arcs["sp_arc_density"] == 0.5 and arcs["sp_reciprocal_arc_fraction"] == pytest.approx(2 / 3) and arcs["sp_no_outgoing_arc_node_fraction"] == pytest.approx(1 / 3)
    assert families.unpack(json.loads(json.dumps(families.pack({(1, 2): [3.0], "a": (1,)})))) == {(1, 2): [3.0], "a": (1,)}


def test_failures_are_audited(spark):
    rows = spark.createDataFrame([("a", "packing", '{"sizes":[1],"capacity":0}'), ("b", "packing", '{"sizes":[1,2],"capacity":4}'), ("c", "packing", "{}")], "instance_id string, family string, payload string")
    got = {r.instance_id: r for r in families.family_features(rows).collect()}
    assert "invalid_packing_dimensions" in got["a"].reason and got["b"].reason is None and got["c"].reason.startswith("KeyError")


def test_shape_of_a_disk(spark):
    rng = np.random.default_rng(3)
    r, t = np.sqrt(rng.random(3000)), rng.random(3000) * 2 * math.pi
    z = np.stack([r * np.cos(t), r * np.sin(t)], 1)
    turned = z @ np.array([[0.6, -0.8], [0.8, 0.6]]) * 7 + 3
    cloud = spark.createDataFrame([(k, float(a), float(b)) for k, x in enumerate((z, turned)) for a, b in x], "cloud_id int, z1 double, z2 double")
    a, b = shape.shape_metrics(cloud).orderBy("cloud_id").collect()
    assert a.target_met and a.covariance_ratio == pytest.approx(b.covariance_ratio) and a.sector_cv == pytest.approx(b.sector_cv, abs=1e-3)
    d = {r.cloud_id: r for r in shape.cloud_diagnostics(cloud).collect()}
    assert d[0].hull_circularity > 0.97 and d[1].inner_half_radius_fraction == pytest.approx(0.25, abs=0.05)


def test_hull_and_coverage(spark):
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0]])
    assert len(shape.hull(square)) == 4
    with pytest.raises(ValueError):
        shape.hull(np.array([[0, 0], [1, 1], [2, 2]]))
    points = spark.createDataFrame([(0.0, 0.0), (0.1, 0.1)], "z1 double, z2 double")
    first = shape.coverage_targets(points, shape.hull(square))[0]
    assert first[:2] == (1.0, 1.0)


def test_projection(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    table = spark.createDataFrame([(f"i{k}", *map(float, r)) for k, r in enumerate(x)], "instance_id string, a double, b double, c double, d double")
    names = list("abcd")
    n, mean, cov = projection.moments(table, names)
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, ddof=0))
    a, b, loss = projection.pilot(table, names[:3], ["d"])
    full = x[:, :3] @ np.linalg.lstsq(x[:, :3], x, rcond=None)[0]
    u, s, v = np.linalg.svd(full, full_matrices=False)
    best = ((x - full) ** 2).sum() + (s[2:] ** 2).sum()
    assert loss * 4 * 300 == pytest.approx(best, rel=1e-6)
    z = projection.project(table, dict(zip(names[:3], map(tuple, a.tolist()), strict=True)))
    projection.verify_projection(table, dict(zip(names[:3], map(tuple, a.tolist()), strict=True)), z)


def test_boxcox():
    rng = np.random.default_rng(2)
    assert abs(projection.boxcox_lambda(np.exp(rng.normal(size=4000)))) < 0.05
    assert abs(projection.boxcox_lambda(rng.normal(10, 1, 4000)) - 1) < 0.5
    fitted = projection.normalization(np.arange(50.0))
    assert projection.normalization(np.ones(5)) is None and fitted["shift"] == 1


def test_id_sets_must_agree(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "instance_id string, f double")
    b = spark.createDataFrame([("x", 1.0)], "instance_id string, g double")
    with pytest.raises(ValueError, match="y"):
        tables.align(a, b)
    with pytest.raises(Exception, match="repeated"):
        tables.unique(a.union(a), "instance_id").collect()


def test_least_energy_over_all_states():
    rng = random.Random(8)
    for k in range(30):
        n, c = rng.randrange(1, 6), rng.randrange(1, 14)
        w, p = [rng.randrange(1, 12) for _ in range(n)], [rng.randrange(20) for _ in range(n)]
        for penalty in (None, 1, 3):
            q, offset = solve.qubo(w, p, c, penalty)
            states = (np.arange(2 ** len(q))[:, None] >> np.arange(len(q))) & 1
            assert solve.by_qubo(w, p, c, penalty) == -(np.einsum("si,ij,sj->s", states, q, states) + offset).min()
    assert solve.by_qubo([5], [9], 3, 1) != solve.optimum([5], [9], 3)[0]  # too small a penalty shows
