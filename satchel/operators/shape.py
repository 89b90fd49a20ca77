"""The shape of point clouds: fit to a uniform disk, hull, boundary and coverage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions.tasks import stored

#: What a cloud must keep to, and how much each measure may get worse.
LIMITS = {"covariance_ratio": 1.25, "radial_uniform_max_deviation": 0.15, "fitted_disk_inside_ratio": 0.95, "sector_cv_above_theoretical_minimum": 0.15}
TOLERANCES = {"covariance_ratio": 0.05, "radial_uniform_max_deviation": 0.02, "fitted_disk_inside_ratio": 0.02, "sector_cv_above_theoretical_minimum": 0.03}
MIN_DELTA, SECTORS = 1e-4, 12
#: The one measure that should be large.
RISING = "fitted_disk_inside_ratio"
#: Partial hulls merged at a time, and corners that a task holds before it passes them on.
FAN, HELD = 16, 1_000_000
EPS, LARGEST = float(np.finfo(float).eps), float(np.finfo(float).max)


def sector_cv(angle: np.ndarray, sectors: int = SECTORS) -> float:
    """The least variation of the sectors' counts over all rotations of the sectors.

    The counts change only when a boundary passes a point, so one rotation from between
    each two neighbouring residues is enough.
    """
    width = 2 * math.pi / sectors
    residue = np.sort(np.mod(np.mod(angle, 2 * math.pi), width))
    phases = np.r_[0.0, np.mod((residue + np.r_[residue[1:], residue[0] + width]) / 2, width)]
    best = math.inf
    for phase in np.unique(phases):
        at = np.minimum((np.mod(angle - phase, 2 * math.pi) / width).astype(int), sectors - 1)
        best = min(best, float(np.bincount(at, minlength=sectors).std()))
    return best / max(len(angle) / sectors, 1e-12)


def centred(points: DataFrame) -> DataFrame:
    """Adds x, y about the cloud's mean and r2."""
    m = points.groupBy("cloud_id").agg(F.avg("z1").alias("m1"), F.avg("z2").alias("m2"), F.count(F.lit(1)).alias("n"))
    rows = points.join(m, "cloud_id").withColumns({"x": F.col("z1") - F.col("m1"), "y": F.col("z2") - F.col("m2")})
    return rows.withColumn("r2", F.col("x") * F.col("x") + F.col("y") * F.col("y"))


def disk_metrics(points: DataFrame) -> DataFrame:
    """Per cloud all measures that need no sweep, in SQL.

    ``points``: cloud_id, z1, z2, finite. A cloud is ranked by radius in one group; clouds
    are independent of each other.
    """
    rows = centred(points)
    spread = rows.groupBy("cloud_id").agg(F.avg(F.col("x") * F.col("x")).alias("vx"), F.avg(F.col("y") * F.col("y")).alias("vy"), F.avg(F.col("x") * F.col("y")).alias("vxy"), F.avg("r2").alias("mean_r2"), F.max("n").alias("n"))
    half, gap = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("vxy", 2))
    flat = (half + gap <= 0) | (half - gap <= EPS * (half + gap))
    spread = spread.withColumn("covariance_ratio", F.when(flat, LARGEST).otherwise(F.try_divide(half + gap, half - gap))).withColumn("fitted_radius", F.sqrt(2 * F.col("mean_r2")))
    ranked = rows.select("cloud_id", "r2", F.row_number().over(Window.partitionBy("cloud_id").orderBy("r2")).alias("k")).join(spread.select("cloud_id", "fitted_radius", "n"), "cloud_id")
    square = F.greatest(F.col("fitted_radius") * F.col("fitted_radius"), F.lit(float(np.finfo(float).tiny)))
    radial = ranked.groupBy("cloud_id").agg(
        F.max(F.abs(F.col("r2") / square - (F.col("k") - 0.5) / F.col("n"))).alias("radial_uniform_max_deviation"), F.avg((F.sqrt("r2") <= 1.02 * F.col("fitted_radius")).cast("double")).alias("fitted_disk_inside_ratio")
    )
    return spread.join(radial, "cloud_id").select("cloud_id", F.col("n").alias("sample_count"), "fitted_radius", "covariance_ratio", "radial_uniform_max_deviation", "fitted_disk_inside_ratio")


def sector_variation(points: DataFrame, sectors: int = SECTORS) -> DataFrame:
    """(cloud_id, sector_cv): ``sector_cv`` of every cloud by one sweep, each cloud dealt over many tasks.

    Turning the boundaries, a point leaves its sector for the one before when a boundary
    passes its residue. With X_k the points of sector k passed so far, sector k then holds
    what it had at first, less X_k, plus X_(k+1). The X are running sums over the sorted
    residues: inside range partitions, plus what the partitions before them hold.
    """
    turn = 2 * math.pi
    width, names = turn / sectors, [f"k{k}" for k in range(sectors)]
    angle = F.pmod(F.atan2("y", "x"), F.lit(turn))
    rows = centred(points).select("cloud_id", angle.alias("angle"), (angle % width).alias("residue"))
    sector = F.pmod(F.round((F.col("angle") - F.col("residue")) / width).cast("int"), F.lit(sectors))
    events = rows.groupBy("cloud_id", "residue").agg(*(F.count_if(sector == k).alias(c) for k, c in enumerate(names)))
    sliced = stored(events.repartitionByRange("cloud_id", "residue").withColumn("slice", F.spark_partition_id()), "sweep")
    held = sliced.groupBy("cloud_id", "slice").agg(*(F.sum(c).alias(c) for c in names))  # a row per cloud and partition
    earlier, all_of = Window.partitionBy("cloud_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("cloud_id")
    held = held.select("cloud_id", "slice", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in names), *(F.sum(c).over(all_of).alias(f"all_{c}") for c in names))
    here = Window.partitionBy("cloud_id", "slice").orderBy("residue").rowsBetween(Window.unboundedPreceding, 0)
    passed = sliced.select("cloud_id", "slice", *(F.sum(c).over(here).alias(c) for c in names)).join(held, ["cloud_id", "slice"])
    passed = passed.select("cloud_id", *(F.col(f"all_{c}").alias(f"all_{c}") for c in names), *((F.col(c) + F.col(f"before_{c}")).alias(c) for c in names))
    even = sum((F.col(f"all_{c}") for c in names), F.lit(0)) / sectors
    counts = [F.col(f"all_{c}") - F.col(c) + F.col(following) for c, following in zip(names, names[1:] + names[:1], strict=True)]
    spread = sum((F.pow(c - even, F.lit(2.0)) for c in counts), F.lit(0.0)) / sectors
    return passed.groupBy("cloud_id").agg((F.sqrt(F.min(spread)) / F.greatest(F.max(even), F.lit(1e-12))).alias("sector_cv"))


def shape_metrics(points: DataFrame, limits: dict[str, float] = LIMITS, sectors: int = SECTORS) -> DataFrame:
    """``disk_metrics`` with the sector measures, the composite score and whether the limits are met."""
    out = disk_metrics(points).join(sector_variation(points, sectors), "cloud_id")
    rest = F.col("sample_count") % sectors
    out = out.withColumn("sector_cv_theoretical_minimum", F.sqrt(rest * (sectors - rest)) / F.col("sample_count"))
    out = out.withColumn("sector_cv_above_theoretical_minimum", F.greatest(F.lit(0.0), F.col("sector_cv") - F.col("sector_cv_theoretical_minimum")))
    score = F.ln("covariance_ratio") + 2 * F.col("radial_uniform_max_deviation") + 1 - F.col(RISING) + F.col("sector_cv_above_theoretical_minimum")
    met = F.lit(True)
    for name, limit in limits.items():
        met = met & ((F.col(name) >= limit) if name == RISING else (F.col(name) <= limit))
    return out.withColumn("composite_score", score).withColumn("target_met", met)


def deficit_terms(metric: dict[str, Column], limits: dict[str, float] = LIMITS) -> dict[str, Column]:
    """How far each measure is past its limit, by the limit."""
    return {k: F.greatest((limit - metric[k]) if k == RISING else (metric[k] - limit), F.lit(0.0)) / limit for k, limit in limits.items()}


def acceptance(pairs: DataFrame, limits: dict[str, float] = LIMITS, tolerances: dict[str, float] = TOLERANCES, min_delta: float = MIN_DELTA) -> DataFrame:
    """Adds whether the step from struct ``before`` to struct ``after`` is accepted, and why not.

    No measure may get worse by more than its tolerance or leave its limit, and the
    total deficit must vanish or shrink by ``min_delta``.
    """
    old, new = ({k: F.col(side)[k] for k in limits} for side in ("before", "after"))
    total = lambda m: sum(deficit_terms(m, limits).values(), F.lit(0.0))
    gain = {k: (new[k] - old[k]) if k == RISING else (old[k] - new[k]) for k in limits}
    keeps = lambda m, k: m[k] >= limits[k] if k == RISING else m[k] <= limits[k]
    named = lambda tests: F.filter(F.array(*(F.when(bad, F.lit(k)) for k, bad in tests.items())), lambda x: x.isNotNull())
    rows = pairs.withColumns({
        "before_deficit": total(old), "after_deficit": total(new),
        "tolerance_violations": named({k: gain[k] < -tolerances[k] - 1e-15 for k in limits}), "boundary_violations": named({k: keeps(old, k) & ~keeps(new, k) for k in limits}),
    })
    better = F.col("before_deficit") - F.col("after_deficit")
    passed = (F.size("tolerance_violations") == 0) & (F.size("boundary_violations") == 0) & ((F.col("after_deficit") <= 1e-15) | (better >= min_delta))
    return rows.withColumns({"deficit_improvement": better, "passed": passed})


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    p = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(p) < 3:
        raise ValueError("fewer than three different points")

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    corners = np.array([*chain(p), *chain(p[::-1])])
    if len(corners) < 3:
        raise ValueError("points on a line")
    return corners


def half_planes(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outward unit normals n and offsets o of the edges: inside is n.z + o <= 0."""
    edge = np.roll(corners, -1, axis=0) - corners
    n = np.stack([edge[:, 1], -edge[:, 0]], 1) / np.linalg.norm(edge, axis=1)[:, None]
    return n, -(n * corners).sum(1)


def extremes(points: np.ndarray) -> np.ndarray:
    """The points that can be corners of a hull of these and others: the corners, or the ends and an inner point of a line."""
    p = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    try:
        return hull(p)
    except ValueError:
        return p[[0, len(p) // 2, -1]] if len(p) > 2 else p


def cloud_corners(points: DataFrame) -> DataFrame:
    """(cloud_id, x, y): the extremes of each cloud, by hulls of parts merged as a tree.

    A task keeps the hull of what it has seen of a cloud; then the hulls of FAN tasks at a
    time are merged, until one is left. No task sees a cloud, only corners.
    """
    kind = points.schema["cloud_id"].dataType.simpleString()

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, size = TaskContext.get().partitionId(), {}, 0
        for f in frames:
            for cloud, rows in f.groupby("cloud_id", sort=False):
                old = held.get(cloud, np.empty((0, 2)))
                held[cloud] = extremes(np.concatenate([old, rows[["z1", "z2"]].to_numpy(dtype=float)]))
                size += len(held[cloud]) - len(old)
            if size > HELD:
                yield from tables(held, task)
                held, size = {}, 0
        yield from tables(held, task)

    def tables(held: dict, task: int) -> Iterator[pd.DataFrame]:
        for cloud, p in held.items():
            yield pd.DataFrame({"cloud_id": cloud, "part": task, "x": p[:, 0], "y": p[:, 1]})

    def joined(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        p = extremes(f[["x", "y"]].to_numpy())
        return pd.DataFrame({"cloud_id": key[0], "part": key[1], "x": p[:, 0], "y": p[:, 1]})

    schema = f"cloud_id {kind}, part long, x double, y double"
    corners = stored(points.select("cloud_id", "z1", "z2").where("cloud_id IS NOT NULL").mapInPandas(seen, schema), "corners")
    parts = 1 + (corners.agg(F.max("part")).head()[0] or 0)
    while True:
        corners = corners.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("cloud_id", "part").applyInPandas(joined, schema)
        if (parts := -(-parts // FAN)) == 1:
            return corners.drop("part")


def hull_shape(corners: np.ndarray) -> tuple[float, float, float, float]:
    """Circularity, variation of the radius over 360 directions, and centre of area of a hull."""
    following = np.roll(corners, -1, axis=0)
    cross = corners[:, 0] * following[:, 1] - corners[:, 1] * following[:, 0]
    area = cross.sum() / 2
    centre = ((corners + following) * cross[:, None]).sum(0) / (6 * area)
    normal, offset = half_planes(corners)
    ways = np.linspace(0, 2 * math.pi, 360, endpoint=False)
    speed = normal @ np.stack([np.cos(ways), np.sin(ways)])
    reach = np.where(speed > 1e-12, -(normal @ centre + offset)[:, None] / np.where(speed > 1e-12, speed, 1), np.inf).min(0)
    perimeter = np.linalg.norm(following - corners, axis=1).sum()
    return 4 * math.pi * area / perimeter**2, reach.std() / reach.mean(), *centre


def cloud_diagnostics(points: DataFrame) -> DataFrame:
    """Hull diagnostics per cloud; a cloud without area has a reason instead."""
    kind = points.schema["cloud_id"].dataType.simpleString()
    names = ("hull_circularity", "covariance_axis_ratio", "hull_radius_cv", "inner_half_radius_fraction")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        try:
            found = (*hull_shape(hull(f[["x", "y"]].to_numpy())), None)
        except ValueError as error:
            found = (*[None] * 4, str(error))
        return pd.DataFrame([(key[0], *found)], columns=["cloud_id", names[0], names[2], "cx", "cy", "reason"])

    hulls = stored(cloud_corners(points).groupBy("cloud_id").applyInPandas(run, f"cloud_id {kind}, {names[0]} double, {names[2]} double, cx double, cy double, reason string"), "hulls")
    moved = points.where("cloud_id IS NOT NULL").join(hulls.select("cloud_id", "cx", "cy"), "cloud_id").withColumn("r", F.hypot(F.col("z1") - F.col("cx"), F.col("z2") - F.col("cy")))
    whole = moved.groupBy("cloud_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.var_pop("z1").alias("vx"), F.var_pop("z2").alias("vy"), F.covar_pop("z1", "z2").alias("vxy"), F.max("r").alias("far"))
    inner = moved.join(whole.select("cloud_id", "far"), "cloud_id").groupBy("cloud_id").agg(F.avg((F.col("r") <= F.col("far") / 2).cast("double")).alias(names[3]))
    half, gap = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("vxy", 2))
    flat = F.col("reason").isNotNull()
    row = hulls.join(whole, "cloud_id").join(inner, "cloud_id").withColumn(names[1], F.sqrt(F.try_divide(F.greatest(half - gap, F.lit(0.0)), half + gap)))
    return row.select("cloud_id", "n", *(F.when(~flat, F.col(k)).alias(k) for k in names), "reason")


def box_corners(lower: np.ndarray, upper: np.ndarray, projection: np.ndarray, correlation: np.ndarray, threshold: float = 0.7) -> tuple[np.ndarray, np.ndarray, bool]:
    """(boundary, kept corners, fallback): the hull of the projected corners of a box of features.

    Corners that put strongly correlated features at opposite ends (or strongly opposed
    ones at the same end) are left out; if the rest has no area, all corners count.
    """
    p = len(lower)
    bits = (np.arange(1 << p)[:, None] >> np.arange(p)[::-1]) & 1
    corners = np.where(bits, upper, lower) @ projection
    i, j = np.triu_indices(p, 1)
    differ = bits[:, i] != bits[:, j]
    impossible = (differ & (correlation[i, j] > threshold)) | (~differ & (correlation[i, j] < -threshold))
    kept = corners[~impossible.any(1)]
    everything = hull(corners)
    try:
        return hull(kept), kept, False
    except ValueError:
        return everything, kept, True


def coverage_targets(points: DataFrame, boundary: np.ndarray, grid: int = 15, count: int = 12) -> list[tuple[float, float, float]]:
    """(z1, z2, distance) of up to ``count`` places inside the boundary that are farthest from all points, spaced apart.

    Distances to the at most grid^2 places are a minimum per place, combined before the
    shuffle; only the places are collected.
    """
    lo, hi = boundary.min(0), boundary.max(0)
    places = np.stack(np.meshgrid(*(np.linspace(a, b, grid) for a, b in zip(lo, hi, strict=True)), indexing="ij"), -1).reshape(-1, 2)
    normal, offset = half_planes(hull(boundary))
    places = places[(places @ normal.T + offset <= 1e-10).all(1)]
    array = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(places)))
    far = points.select("z1", "z2", F.explode(array).alias("g")).groupBy("g.k").agg(F.min(F.hypot(F.col("z1") - F.col("g.a"), F.col("z2") - F.col("g.b"))).alias("d"))
    distance = {r.k: r.d for r in far.collect()}
    space, chosen = np.linalg.norm(hi - lo) / grid, []
    for k in sorted(distance, key=lambda k: (-distance[k], k)):
        if len(chosen) < count and all(np.linalg.norm(places[k] - places[m]) >= space for m in chosen):
            chosen.append(k)
    return [(*map(float, places[k]), float(distance[k])) for k in chosen]
