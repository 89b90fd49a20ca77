"""Frozen maps: every check before one is applied, and JSON documents."""

import json

import pytest
from pyspark.sql import functions as F

from satchel.operators import augment
from satchel.plans import frozen, projection
from satchel.sources import tables

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted_once(spark):
    raw = spark.createDataFrame([(f"i{k}", float(k), float(k * k), float((k * 7) % 11)) for k in range(1, 30)], "instance_id string, a double, b double, c double")
    return raw, {r.feature: r.asDict() for r in projection.fit_normalization(raw).collect()}


@pytest.fixture
def fit(spark, tmp_path, fitted_once):
    """A function that writes a fit, changed by ``change(name, table)``; signed before or after the change."""
    raw, fitted = fitted_once
    x = projection.apply_normalization(raw, fitted).coalesce(1)
    weights = {"a": (0.5, 0.1), "b": (-0.25, 1.0), "c": (0.0, 2.0)}

    def write(name="fit", change=lambda name, table: table, signed=True, **summary):
        folder = str(tmp_path / name)
        made = {
            "prelim": spark.createDataFrame([(k, *(p[c] for c in frozen.NORMALIZATION)) for k, p in fitted.items()], "feature string, shift double, lambda double, anchor double, mean double, std double").coalesce(1),
            "projection_matrix": spark.createDataFrame([(k, *w) for k, w in weights.items()], "feature string, z1 double, z2 double").coalesce(1), "coordinates": projection.project(x, weights), "selected_features": x.select("instance_id", *NAMES),
        }
        for k, t in made.items():
            tables.write_table(change(k, t), f"{folder}/{k}")
        tables.write_json(spark, frozen.KIND | {"projection_fitted": True, "projection_modified": False, "selected": NAMES} | summary, f"{folder}/summary")
        if signed:
            frozen.sign(spark, folder)
        return folder

    return write, raw, projection.project(x, weights)


def test_a_sound_fit_is_applied_to_all_rows(spark, fit):
    write, raw, z = fit
    fitted, weights = frozen.load(spark, write())
    assert list(fitted) == list(weights) == NAMES
    got = {r.instance_id: (r.z1, r.z2) for r in frozen.apply(raw.withColumn("other", F.lit(1.0)), fitted, weights).collect()}
    assert got == {r.instance_id: (pytest.approx(r.z1), pytest.approx(r.z2)) for r in z.collect()}
    with pytest.raises(ValueError, match="no instances"):
        frozen.apply(raw.limit(0), fitted, weights)
    with pytest.raises(ValueError, match="missing"):
        frozen.apply(raw.drop("b"), fitted, weights)


def only(which, f):
    return lambda name, table: f(table) if name == which else table


CHECKS = [
    ("another problem", {"problem": "TSP"}, None), ("another problem or form", {"variant": "x"}, None), ("not fitted", {"projection_fitted": False}, None), ("changed afterwards", {"projection_modified": True}, None),
    ("map and the declared", {}, only("projection_matrix", lambda t: t.where("feature <> 'b'"))), ("map and the declared", {"selected": ["a", "b"]}, None), ("training features and the declared", {}, only("selected_features", lambda t: t.select("instance_id", "b", "a", "c"))),
    ("without a match", {}, only("coordinates", lambda t: t.where("instance_id <> 'i3'"))), ("must be finite", {}, only("projection_matrix", lambda t: t.withColumn("z1", F.when(F.col("feature") == "a", float("nan")).otherwise(F.col("z1"))))),
    ("must be finite", {}, only("selected_features", lambda t: t.withColumn("a", F.when(F.col("instance_id") == "i3", None).otherwise(F.col("a"))))), ("do not agree", {}, only("coordinates", lambda t: t.withColumn("z2", F.col("z2") + 1e-9))),
    ("without a normalization", {}, only("prelim", lambda t: t.where("feature <> 'c'"))),
]


@pytest.mark.parametrize("k", range(len(CHECKS)))
def test_each_check(spark, fit, k):
    said, summary, change = CHECKS[k]
    folder = fit[0](change=change or (lambda name, table: table), **summary)
    with pytest.raises(Exception, match=said):
        frozen.load(spark, folder)


def test_artefacts_are_those_that_were_signed(spark, fit, tmp_path):
    folder = fit[0]()
    fit[0]("other", only("projection_matrix", lambda t: t.withColumn("z1", F.col("z1") * 2)), False)
    for part in (tmp_path / "fit/projection_matrix").glob("*part-*"):
        part.unlink()
    for part in (tmp_path / "other/projection_matrix").glob("part-*"):
        (tmp_path / "fit/projection_matrix" / part.name).write_bytes(part.read_bytes())
    with pytest.raises(ValueError, match=r"changed since the fit: \['projection_matrix'\]"):
        frozen.load(spark, folder)


def test_json_documents(spark, tmp_path):
    tables.write_json(spark, {"a": [1.5, "é"]}, str(tmp_path / "d"))
    assert tables.read_json(spark, str(tmp_path / "d")) == {"a": [1.5, "é"]}
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="JSON"):
            tables.write_json(spark, {"a": bad}, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_json(spark, {}, str(tmp_path / "d"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "d").glob("part-*")))


def test_features_that_are_not_finite(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3, 4], 2), (2, [1, 2], [3, 4], None), (3, [0, 0], [1, 1], 1)], "ord long, weights array<bigint>, profit array<bigint>, capacity bigint")
    assert [r.ord for r in augment.finite_features(rows.where("ord < 3")).collect()] == [1]
