"""The queries take in all rows: none is left out by its id, size or cost."""

import importlib
import random

import numpy as np
import pytest

from satchel.operators import augment
from satchel.queries.common import instances

DATA = "/root/testdata/sf0.001"
queries = importlib.import_module("__spark_entry__").queries()


def orders(spark):
    return queries["kp_instances"](spark, DATA).count()


def test_profiles_of_all_orders(spark):
    got = queries["profile_features"](spark, DATA).groupBy("family").sum("rows").collect()
    many = {r[0]: r[1] for r in got}
    assert len(many) == 10 and all(n == orders(spark) * (3 if f == "profile" else 1) for f, n in many.items())


def features(spark, name):
    out = {}
    for r in queries[name](spark, DATA).collect():
        assert r.feature[0] != "!", r
        out.setdefault(r.instance_id, {})[r.feature] = r.value
    return out


def test_all_links_between_brands_and_suppliers(spark):
    line, part = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("lineitem", "part"))
    links = line.join(part, line.l_partkey == part.p_partkey).select("p_brand", "l_suppkey").distinct()
    got = features(spark, "incidence_features")
    assert round(sum(f["incidence_density"] * f["incidence_group_count"] * f["incidence_universe_size"] for f in got.values())) == links.count()
    assert sum(f["incidence_universe_size"] for f in got.values()) == links.select("l_suppkey").distinct().count()


def test_all_arcs_between_nations(spark):
    assert features(spark, "shortest_path_features")["nations"]["sp_arc_density"] == 1
    flow = features(spark, "network_flow_features")["nations"]
    assert flow["arc_cost_count"] == 600, flow


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Orders of 2, 3, 9, 11, 13 and 16 lines."""
    rng = random.Random(1)
    rows = [(n, i, rng.randrange(1, 50), rng.randrange(1, 20), float(rng.randrange(1, 51)), float(rng.randrange(900, 9000))) for n in (2, 3, 9, 11, 13, 16) for i in range(1, n + 1)]
    folder = tmp_path_factory.mktemp("mixed")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_optimum_of_orders_of_all_sizes(spark, mixed):
    got = {r.instance_id: r.objective for r in queries["kp_optimum_all"](spark, mixed).collect()}
    found = {r.instance_id: r for r in instances(spark, mixed).collect()}
    assert set(got) == set(found) and len(got) == 6
    for k, r in found.items():
        sets = (np.arange(2 ** len(r.weights))[:, None] >> np.arange(len(r.weights))) & 1
        assert got[k] == (sets @ np.array(r.profit))[sets @ np.array(r.weights) <= r.capacity].max()


@pytest.mark.parametrize("name", ["packing_all_features", "compatibility_features", "subset_sum_features", "quadratic_features"])
def test_features_of_orders_of_all_sizes(spark, mixed, name):
    rows = queries[name](spark, mixed).collect()
    assert {r.instance_id for r in rows} == {f"order_{n}" for n in (2, 3, 9, 11, 13, 16)} and all(r.feature[0] != "!" for r in rows)
    assert name != "packing_all_features" or {"relative_size_mean", "bin_capacity"} <= {r.feature for r in rows}


def test_any_order_is_a_parent(spark):
    got = queries["kp_generate"](spark, DATA).where("parent_instance_id <> 'random'").select("parent_instance_id").distinct().collect()
    known = {r.instance_id for r in instances(spark, DATA).collect()}
    found = {r[0] for r in got}
    assert found <= known and len(found) > 0.5 * len(known)


def test_places_of_parents(spark):
    parents = [(f"p{k}", ([k + 1, k + 2], [3, 4], k + 1)) for k in range(9)]
    rows = augment.attempts(spark, parents, 400, 3).collect()
    names = list(augment.MUTATIONS)
    for r in rows:
        rng = np.random.default_rng(3 + augment.STRIDE * r.ord)
        if rng.random() < augment.RANDOM_SHARE:
            n, c = (int(rng.choice(x)) for x in ([2] * 9, [x[2] for _, x in parents]))
            want, parent = augment.draw_instance(rng, n, c, shape_first=True)[0], None
        else:
            op = names[int(rng.integers(len(names)))]
            parent, x = parents[int(rng.integers(9))]
            want = augment.mutate(x, op, rng)[0]
        assert (r.parent_id, list(r.weights), list(r.profit), r.capacity) == (parent, *want)
