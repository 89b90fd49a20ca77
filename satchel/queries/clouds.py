"""Point clouds and projections: embeddings' first dimensions by label, and fitted maps of features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import features, shape
from satchel.plans import projection
from satchel.queries import knapsack
from satchel.queries.common import INSTANCES, instances, rounded, sig

FIXED = {"weights_mean": {"shift": 1.0, "lambda": 0.5, "anchor": 3.0, "mean": 0.1, "std": 0.8}, "kp_pair_fit_ratio": {"shift": 1.0, "lambda": -1.5, "anchor": 0.2, "mean": -0.3, "std": 0.4}}
CHOSEN = ["weights_count", "weights_cv", "profit_cv", "capacity_total_weight_ratio", "kp_pair_fit_ratio", "kp_weight_profit_pearson", "kp_weight_gini", "kp_profit_gini", "kp_oversize_item_ratio", "profit_weight_ratio_cv", "kp_partner_fraction_std", "weights_skew"]


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IS NOT NULL AND embedding IS NOT NULL")
    return rows.select(F.col("label").alias("cloud_id"), F.get("embedding", F.lit(0)).cast("double").alias("z1"), F.get("embedding", F.lit(1)).cast("double").alias("z2"))


def cloud_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.disk_metrics(_cloud(spark, sf_dir)))


def cloud_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.shape_metrics(_cloud(spark, sf_dir)))


def cloud_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.cloud_diagnostics(_cloud(spark, sf_dir)))


def cloud_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = _cloud(spark, sf_dir)
    box = cloud.agg(F.min("z1"), F.max("z1"), F.min("z2"), F.max("z2")).head()
    corners = np.array([(x, y) for x in box[:2] for y in box[2:]])
    found = shape.coverage_targets(cloud, shape.hull(corners))
    return rounded(spark.createDataFrame(found, "z1 double, z2 double, distance double"))


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's cloud as a step from the cloud of the label before."""
    measures = shape.shape_metrics(_cloud(spark, sf_dir))
    names = list(shape.LIMITS)
    old = measures.select((F.col("cloud_id") + 1).alias("cloud_id"), F.struct(*names).alias("before"))
    steps = old.join(measures.select("cloud_id", F.struct(*names).alias("after")), "cloud_id")
    out = shape.acceptance(steps)
    return rounded(out.select("cloud_id", "before_deficit", "after_deficit", F.array_join("tolerance_violations", ",").alias("tolerance_violations"), F.array_join("boundary_violations", ",").alias("boundary_violations"), "passed"))


def _table(spark: SparkSession, sf_dir: str, names: list[str] = CHOSEN) -> DataFrame:
    return features.chosen_features(instances(spark, sf_dir), names)


def frozen_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored normalization and map, applied to all instances."""
    rows = features.domain_features(instances(spark, sf_dir)).join(features.relation_features(instances(spark, sf_dir)), "instance_id")
    x = projection.apply_normalization(rows, FIXED)
    return rounded(projection.project(x, {"weights_mean": (0.7, -0.2), "kp_pair_fit_ratio": (0.1, 0.9)}))


def feature_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted Box-Cox normalization; lambda to three decimals, as it is a numerical optimum."""
    return projection.fit_normalization(_table(spark, sf_dir)).select("feature", F.round("lambda", 3).alias("lambda"), F.round("shift", 6).alias("shift"))


def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without redundancy; then those chosen by two labels derived from the items (synthetic, not measurements)."""
    table = _table(spark, sf_dir)
    table = table.withColumns({"good_tight": (F.col("capacity_total_weight_ratio") < 0.4).cast("double"), "good_even": (F.col("kp_weight_gini") < 0.25).cast("double")}).persist()
    try:
        stable = projection.stable_features(table, CHOSEN)
        chosen, info = projection.select_features(table, stable, ["good_tight", "good_even"])
        return spark.createDataFrame([(n, n in stable, n in info["surviving_features"], n in chosen) for n in CHOSEN], "feature string, stable boolean, screened boolean, chosen boolean")
    finally:
        table.unpersist()


def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map to the plane that best reconstructs normalized features and one synthetic response: its coordinates' spread and its loss."""
    names = ["weights_cv", "profit_cv", "capacity_total_weight_ratio", "kp_weight_gini"]
    table = _table(spark, sf_dir, names).persist()
    try:
        fitted = {r.feature: r.asDict() for r in projection.fit_normalization(table).collect()}
        x = projection.apply_normalization(table, fitted).withColumn("response", F.col("weights_cv") - F.col("profit_cv"))
        a, b, loss = projection.pilot(x, names, ["response"])
        z = projection.project(x, dict(zip(names, map(tuple, a.tolist()), strict=True)))
        out = z.agg(F.count(F.lit(1)).alias("instances"), F.var_pop("z1").alias("v1"), F.var_pop("z2").alias("v2")).head()
        corners, kept, fallback = shape.box_corners(*(np.array(x.agg(*(f(n) for n in names)).head()) for f in (F.min, F.max)), a, projection.correlation(projection.moments(x, names)[2]))
        return spark.createDataFrame([(out.instances, round(out.v1, 3), round(out.v2, 3), round(loss, 3), len(corners), len(kept), fallback)], "instances long, v1 double, v2 double, loss double, boundary_corners int, kept_corners int, fallback boolean")
    finally:
        table.unpersist()


QUERIES = {f.__name__: f for f in (cloud_disk, cloud_shape, cloud_hull, cloud_coverage, acceptance, frozen_projection, feature_normalization, feature_selection, plane_fit)}

_DISK = f"""WITH z AS (SELECT label AS cloud_id, CAST(embedding[1] AS DOUBLE) AS z1, CAST(embedding[2] AS DOUBLE) AS z2 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  m AS (SELECT cloud_id, avg(z1) AS m1, avg(z2) AS m2, count(*) AS n FROM z GROUP BY cloud_id),
  c AS (SELECT cloud_id, z1 - m1 AS x, z2 - m2 AS y, n FROM z JOIN m USING (cloud_id)),
  s AS (SELECT cloud_id, avg(x * x) AS vx, avg(y * y) AS vy, avg(x * y) AS vxy, sqrt(2 * avg(x * x + y * y)) AS radius FROM c GROUP BY cloud_id),
  e AS (SELECT cloud_id, radius, (vx + vy) / 2 AS h, sqrt(pow((vx - vy) / 2, 2) + pow(vxy, 2)) AS g FROM s),
  r AS (SELECT c.cloud_id, c.n, x * x + y * y AS r2, radius, row_number() OVER (PARTITION BY c.cloud_id ORDER BY x * x + y * y) AS k FROM c JOIN e USING (cloud_id)),
  q AS (SELECT cloud_id, any_value(n) AS n, max(abs(r2 / (radius * radius) - (k - 0.5) / n)) AS deviation, avg(CAST(sqrt(r2) <= 1.02 * radius AS INT)) AS inside FROM r GROUP BY cloud_id),
  disk AS (SELECT cloud_id, n AS sample_count, radius AS fitted_radius, (h + g) / (h - g) AS covariance_ratio, deviation AS radial_uniform_max_deviation, inside AS fitted_disk_inside_ratio FROM e JOIN q USING (cloud_id))"""
_WIDTH = "(2 * pi() / 12)"
_SHAPE = _DISK + f""",
  t AS (SELECT cloud_id, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS a FROM c),
  u AS (SELECT cloud_id, a % {_WIDTH} AS residue, CAST(round((a - a % {_WIDTH}) / {_WIDTH}) AS INT) % 12 AS sector FROM t),
  w AS (SELECT cloud_id, {', '.join(f'count(*) FILTER (sector = {k}) OVER p AS b{k}, count(*) FILTER (sector = {k}) OVER q AS x{k}' for k in range(12))}
        FROM u WINDOW p AS (PARTITION BY cloud_id), q AS (PARTITION BY cloud_id ORDER BY residue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  v AS (SELECT cloud_id, min({' + '.join(f'pow(b{k} - x{k} + x{(k + 1) % 12} - even, 2)' for k in range(12))}) AS spread, any_value(even) AS even FROM (SELECT *, ({' + '.join(f'b{k}' for k in range(12))}) / 12 AS even FROM w) GROUP BY cloud_id),
  shape0 AS (SELECT disk.*, sqrt(spread / 12) / even AS sector_cv, sqrt((sample_count % 12) * (12 - sample_count % 12)) / sample_count AS sector_cv_theoretical_minimum FROM disk JOIN v USING (cloud_id)),
  shape AS (SELECT *, greatest(0, sector_cv - sector_cv_theoretical_minimum) AS sector_cv_above_theoretical_minimum FROM shape0)"""
_DEFICIT = "(greatest({0}.covariance_ratio - 1.25, 0) / 1.25 + greatest({0}.radial_uniform_max_deviation - 0.15, 0) / 0.15 + greatest(0.95 - {0}.fitted_disk_inside_ratio, 0) / 0.95 + greatest({0}.sector_cv_above_theoretical_minimum - 0.15, 0) / 0.15)"
_NORMAL = lambda x, k: f"(((exp({FIXED[k]['lambda']} * (ln({x} + {FIXED[k]['shift']}) - {FIXED[k]['anchor']})) - 1) / {FIXED[k]['lambda']} - {FIXED[k]['mean']}) / {FIXED[k]['std']})"

ORACLE = {
    "cloud_disk": _DISK + " SELECT cloud_id, sample_count, " + ", ".join(f"{sig(c)} AS {c}" for c in ("fitted_radius", "covariance_ratio", "radial_uniform_max_deviation", "fitted_disk_inside_ratio")) + " FROM disk",
    "acceptance": _SHAPE + f""", p AS (SELECT a.cloud_id, b.covariance_ratio - a.covariance_ratio AS g1, b.radial_uniform_max_deviation - a.radial_uniform_max_deviation AS g2, a.fitted_disk_inside_ratio - b.fitted_disk_inside_ratio AS g3, b.sector_cv_above_theoretical_minimum - a.sector_cv_above_theoretical_minimum AS g4,
          {_DEFICIT.format('b')} AS d0, {_DEFICIT.format('a')} AS d1, b.covariance_ratio <= 1.25 AND a.covariance_ratio > 1.25 AS b1, b.radial_uniform_max_deviation <= 0.15 AND a.radial_uniform_max_deviation > 0.15 AS b2, b.fitted_disk_inside_ratio >= 0.95 AND a.fitted_disk_inside_ratio < 0.95 AS b3, b.sector_cv_above_theoretical_minimum <= 0.15 AND a.sector_cv_above_theoretical_minimum > 0.15 AS b4
          FROM shape a JOIN shape b ON a.cloud_id = b.cloud_id + 1),
        verdict AS (SELECT *, concat_ws(',', CASE WHEN g1 < -0.05 - 1e-15 THEN 'covariance_ratio' END, CASE WHEN g2 < -0.02 - 1e-15 THEN 'radial_uniform_max_deviation' END, CASE WHEN g3 < -0.02 - 1e-15 THEN 'fitted_disk_inside_ratio' END, CASE WHEN g4 < -0.03 - 1e-15 THEN 'sector_cv_above_theoretical_minimum' END) AS t,
          concat_ws(',', CASE WHEN b1 THEN 'covariance_ratio' END, CASE WHEN b2 THEN 'radial_uniform_max_deviation' END, CASE WHEN b3 THEN 'fitted_disk_inside_ratio' END, CASE WHEN b4 THEN 'sector_cv_above_theoretical_minimum' END) AS o FROM p)
        SELECT cloud_id, {sig('d0')} AS before_deficit, {sig('d1')} AS after_deficit, t AS tolerance_violations, o AS boundary_violations, t = '' AND o = '' AND (d1 <= 1e-15 OR d0 - d1 >= 1e-4) AS passed FROM verdict""",
    "cloud_shape": _SHAPE + ", met AS (SELECT *, ln(covariance_ratio) + 2 * radial_uniform_max_deviation + 1 - fitted_disk_inside_ratio + sector_cv_above_theoretical_minimum AS composite_score, covariance_ratio <= 1.25 AND radial_uniform_max_deviation <= 0.15 AND fitted_disk_inside_ratio >= 0.95 AND sector_cv_above_theoretical_minimum <= 0.15 AS target_met FROM shape)"
        + " SELECT cloud_id, sample_count, target_met, " + ", ".join(f"{sig(c)} AS {c}" for c in ("fitted_radius", "covariance_ratio", "radial_uniform_max_deviation", "fitted_disk_inside_ratio", "sector_cv", "sector_cv_theoretical_minimum", "sector_cv_above_theoretical_minimum", "composite_score")) + " FROM met",
    "frozen_projection": f"""WITH {INSTANCES}, f AS (SELECT instance_id, avg(w) AS wm FROM it GROUP BY instance_id),
        g AS (SELECT a.instance_id, avg(CAST(1.0 - a.w * 1.0 / a.c - z.w * 1.0 / z.c >= -1e-12 AS INT)) AS fit FROM it a JOIN it z ON a.instance_id = z.instance_id AND a.i < z.i GROUP BY a.instance_id),
        x AS (SELECT instance_id, {_NORMAL('wm', 'weights_mean')} AS x1, {_NORMAL('fit', 'kp_pair_fit_ratio')} AS x2 FROM f JOIN g USING (instance_id))
        SELECT instance_id, {sig('0.7 * x1 + 0.1 * x2')} AS z1, {sig('-0.2 * x1 + 0.9 * x2')} AS z2 FROM x""",
}


def _boxcox_sql(rounds: int = 4) -> str:
    """The power of least variance: 129 candidates, then four times 33 between the best one's neighbours."""
    bend = lambda lam: f"CASE WHEN {lam} = 0 THEN l ELSE (exp({lam} * l) - 1) / {lam} END"
    steps = [f"g0 AS (SELECT feature, g.range / 2.0 - 32 AS lam, var_pop({bend('(g.range / 2.0 - 32)')}) AS v FROM l CROSS JOIN range(129) g GROUP BY 1, 2), b0 AS (SELECT feature, arg_min(lam, v) AS lam, 0.5 AS step FROM g0 GROUP BY 1)"]
    for k in range(1, rounds + 1):
        lam = "(b.lam + (g.range - 16) * b.step / 16)"
        steps.append(f"g{k} AS (SELECT feature, {lam} AS lam, any_value(b.step) AS step, var_pop({bend(lam)}) AS v FROM l JOIN b{k - 1} b USING (feature) CROSS JOIN range(33) g GROUP BY 1, 2), b{k} AS (SELECT feature, arg_min(lam, v) AS lam, any_value(step) / 16 AS step FROM g{k} GROUP BY 1)")
    return ", ".join(steps) + f", best AS (SELECT * FROM b{rounds})"


ORACLE["feature_normalization"] = f"""WITH f AS (SELECT d.instance_id, {', '.join(CHOSEN)} FROM ({knapsack.ORACLE['kp_domain_features']}) d JOIN ({knapsack.ORACLE['kp_relation_features']}) r USING (instance_id)),
  x AS MATERIALIZED (SELECT feature, value FROM (UNPIVOT f ON {', '.join(CHOSEN)} INTO NAME feature VALUE value)),
  s AS (SELECT feature, 1 - min(value) AS shift FROM x GROUP BY 1 HAVING min(value) < max(value)),
  l AS MATERIALIZED (SELECT feature, ln(value + shift) - avg(ln(value + shift)) OVER (PARTITION BY feature) AS l FROM x JOIN s USING (feature)), {_boxcox_sql()}
  SELECT feature, CAST(round(lam, 3) AS DOUBLE) AS lambda, CAST(round(shift, 6) AS DOUBLE) AS shift FROM best JOIN s USING (feature)"""

ORACLE["cloud_coverage"] = f"""WITH RECURSIVE z AS (SELECT CAST(embedding[1] AS DOUBLE) AS z1, CAST(embedding[2] AS DOUBLE) AS z2 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  box AS (SELECT min(z1) AS a0, max(z1) AS a1, min(z2) AS b0, max(z2) AS b1 FROM z),
  place AS (SELECT i.range * 15 + j.range AS k, a0 + i.range * (a1 - a0) / 14 AS a, b0 + j.range * (b1 - b0) / 14 AS b, sqrt(pow(a1 - a0, 2) + pow(b1 - b0, 2)) / 15 AS space FROM box, range(15) i, range(15) j),
  far AS (SELECT k, a, b, any_value(space) AS space, min(sqrt(pow(z1 - a, 2) + pow(z2 - b, 2))) AS d FROM place, z GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (ORDER BY d DESC, k) AS r FROM far),
  walk(r, got) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(a DOUBLE, b DOUBLE, d DOUBLE)[]) UNION ALL
    SELECT x.r, CASE WHEN len(got) < 12 AND len(list_filter(got, lambda q: sqrt(pow(q.a - x.a, 2) + pow(q.b - x.b, 2)) < x.space)) = 0 THEN list_append(got, {{'a': x.a, 'b': x.b, 'd': x.d}}) ELSE got END FROM walk JOIN ranked x ON x.r = walk.r + 1),
  chosen AS (SELECT unnest(got) AS p FROM walk WHERE r = 225)
  SELECT {sig('p.a')} AS z1, {sig('p.b')} AS z2, {sig('p.d')} AS distance FROM chosen"""
