"""Sweeps and hulls that are split over tasks, against a cloud in one array."""

import math

import numpy as np
import pytest

from satchel.operators import shape


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(7)
    grid = np.array([(i, j) for i in range(-4, 5) for j in range(-4, 5)], dtype=float)
    return {
        "round": rng.normal(size=(500, 2)), "odd": rng.normal(size=(97, 2)) * [3, 0.2] + 5, "grid": grid, "few": rng.normal(size=(5, 2)), "triangle": np.array([[0.0, 0], [4, 0], [0, 3]]),
        "line": np.array([[k, 2.0 * k] for k in range(6)]), "same": np.ones((9, 2)), "copies": np.repeat(rng.normal(size=(4, 2)), 30, axis=0), "pair": np.array([[0.0, 1], [1, 0]]),
    }


@pytest.fixture(scope="module")
def points(spark, clouds):
    return spark.createDataFrame([(k, float(x), float(y)) for k, z in clouds.items() for x, y in z], "cloud_id string, z1 double, z2 double").repartition(23)


def test_sweep(points, clouds):
    got = {r.cloud_id: r.sector_cv for r in shape.sector_variation(points).collect()}
    assert set(got) == set(clouds)
    for k in ("round", "odd", "few", "copies"):
        z = clouds[k] - clouds[k].mean(0)
        assert got[k] == pytest.approx(shape.sector_cv(np.arctan2(z[:, 1], z[:, 0])), abs=1e-9), k
    assert got["grid"] >= 0


@pytest.mark.parametrize("sectors", [1, 2, 5])
def test_sweep_with_other_sectors(points, clouds, sectors):
    got = {r.cloud_id: r.sector_cv for r in shape.sector_variation(points, sectors).collect()}
    for k in ("round", "odd"):
        z = clouds[k] - clouds[k].mean(0)
        assert got[k] == pytest.approx(shape.sector_cv(np.arctan2(z[:, 1], z[:, 0]), sectors), abs=1e-9)


@pytest.mark.parametrize("fan", [2, 16])
def test_corners(points, clouds, monkeypatch, fan):
    monkeypatch.setattr(shape, "FAN", fan)
    got = {}
    for r in shape.cloud_corners(points).collect():
        got.setdefault(r.cloud_id, set()).add((r.x, r.y))
    for k in ("same", "pair"):
        assert got[k] == {tuple(p) for p in clouds[k]}
    assert len(got["line"]) == 3 and got["line"] >= {(0.0, 0.0), (5.0, 10.0)}
    for k in ("round", "odd", "grid", "few", "triangle", "copies"):
        assert got[k] == {tuple(p) for p in shape.hull(clouds[k])}


def test_diagnostics(points, clouds):
    got = {r.cloud_id: r for r in shape.cloud_diagnostics(points).collect()}
    assert {k: r.reason for k, r in got.items() if r.reason} == {"line": "points on a line", "same": "fewer than three different points", "pair": "fewer than three different points"}
    for k in ("round", "odd", "few", "triangle", "grid"):
        z, r = clouds[k], got[k]
        c = shape.hull(z)
        following = np.roll(c, -1, axis=0)
        cross = c[:, 0] * following[:, 1] - c[:, 1] * following[:, 0]
        centre = ((c + following) * cross[:, None]).sum(0) / (3 * cross.sum())
        far = np.linalg.norm(z - centre, axis=1)
        eig = np.linalg.eigvalsh(np.cov(z.T))
        assert r.n == len(z) and r.hull_circularity == pytest.approx(2 * math.pi * cross.sum() / np.linalg.norm(following - c, axis=1).sum() ** 2)
        assert r.inner_half_radius_fraction == pytest.approx((far <= far.max() / 2).mean()) and r.covariance_axis_ratio == pytest.approx(math.sqrt(eig[0] / eig[1]), abs=1e-7)
    square = shape.hull_shape(np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]]))
    assert square == pytest.approx((math.pi / 4, square[1], 1, 1)) and 0.1 < square[1] < 0.13
