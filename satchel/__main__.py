"""Command line: ``python -m satchel extract|augment|solve|project``."""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions.tasks import stored
from satchel.operators import augment, features, hashing, shape, solve, text
from satchel.plans import frozen, projection
from satchel.sources import adapter, tables


def extract(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Word problems of a corpus to instances as JSON lines; equal and proportional repeats are dropped, in the corpus' order."""
    # Stored, so that the order and the parser's work outlive executors.
    rows = stored(tables.read_corpus(spark, a.corpus).withColumn("ord", F.monotonically_increasing_id()).withColumn("instance_id", F.col("ord").cast("string")), "corpus")
    parsed = stored(text.parse_questions(rows).withColumn("ord", F.col("instance_id").cast("long")).where("parsed"), "parsed")
    kept = hashing.numbered(hashing.dedupe(parsed)).join(rows.select("ord", "base_id", "source"), "ord")
    kept = stored(hashing.with_proportional_hash(kept), "kept")
    lineage = F.struct("base_id", "source", "canonical_hash", "proportional_hash")
    out = kept.select("ord", F.col("numbered_id").alias("instance_id"), F.lit("sage_original").alias("origin"), F.lit("domain").alias("variant"), F.struct("weights", "profit", "capacity").alias("parameters"), lineage.alias("lineage"))
    tables.write_instances(out, a.output, "ord")
    return {"rows": rows.count(), "parsed": parsed.count(), "kept": kept.count()}


def augment_(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = tables.read_instances(spark, a.parents).select("instance_id", "weights", "profit", "capacity").withColumn("ord", F.monotonically_increasing_id())
    parents = rows.orderBy("ord").limit(a.max_parents) if a.max_parents else rows
    made = augment.generate(spark, parents, a.max_rounds * a.candidates_per_round, a.seed, rows).persist()
    made.orderBy("sequence").write.mode("errorifexists").json(f"{a.output_dir}/instances")
    both = rows.select("instance_id", "weights", "profit", "capacity").unionByName(made.select("instance_id", "weights", "profit", "capacity"))
    scaled = projection.clamped_normalization(features.all_features(both)).persist()
    names = projection.stable_features(scaled, [c for c in scaled.columns if c != "instance_id"])
    out = {"generated": made.count(), "features": len(names)}
    if len(names) >= 2:
        plane = projection.principal_map(scaled, names)
        z = projection.project(scaled, dict(zip(names, map(tuple, plane.tolist()), strict=True)))
        tables.write_table(z, f"{a.output_dir}/coordinates")
        out |= shape.shape_metrics(z.withColumn("cloud_id", F.lit(0))).drop("cloud_id").head().asDict()
    return out


def solve_(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = tables.read_instances(spark, a.instances)
    rows = rows.limit(a.max_instances) if a.max_instances else rows
    found = solve.run_formulations(rows, a.time_limit).persist()
    for name, value in (("performance", "seconds"), ("good", "good"), ("objectives", "objective")):
        tables.write_table(solve.wide(found, value), f"{a.output_dir}/{name}")
    return {r.formulation: r.n for r in found.groupBy("formulation").agg(F.sum("good").alias("n")).collect()}


def _points(z: DataFrame, origins: DataFrame, output_dir: str) -> dict:
    """Writes the point table (instance_id, z1, z2, label); (label: points)."""
    rows = tables.align(z, origins).select("instance_id", "z1", "z2", tables.origin_label(F.col("origin")).alias("label")).persist()
    tables.write_table(rows, f"{output_dir}/points")
    return {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # a row per origin


def _shape(z: DataFrame) -> dict:
    """Hull diagnostics of one cloud, or why there are none."""
    found = shape.cloud_diagnostics(z.withColumn("cloud_id", F.lit(0))).drop("cloud_id").head()
    if found is None or found.reason:
        return {"available": False, "reason": found.reason if found else "no points"}
    return {"available": True} | {k: v for k, v in found.asDict().items() if k != "reason"}


def _boundary(x: DataFrame, z: DataFrame, weights: dict[str, tuple[float, float]], output_dir: str) -> dict:
    """Writes the reachable boundary of the plane and places in it that are far from all points; what it rests on."""
    names, spark = list(weights), x.sparkSession
    bounds = x.agg(*(f(F.col(f"`{n}`")) for f in (F.min, F.max) for n in names)).head()
    lower, upper = np.array(bounds[: len(names)]), np.array(bounds[len(names) :])
    try:
        corners, kept, fallback = shape.box_corners(lower, upper, np.array(list(weights.values())), projection.correlation(projection.moments(x, names)[2]))
    except ValueError as error:
        return {"available": False, "reason": str(error)}
    tables.write_table(spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(corners)], "corner int, z1 double, z2 double"), f"{output_dir}/boundary")
    targets = shape.coverage_targets(z, corners)
    tables.write_table(spark.createDataFrame(targets, "z1 double, z2 double, distance double"), f"{output_dir}/coverage_targets")
    return {"available": True, "corners": len(corners), "kept_corners": len(kept), "all_corners_used": bool(fallback), "coverage_targets": len(targets)}


def project_(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Instances or their features to the plane.

    ``--instances`` are audited and kept as they came; if any of them is bad, nothing else is done. ``--features``
    need ``--origins``, as sources are never inferred. Features and normalized features are
    written. With ``--performance`` and ``--good`` a map is fitted over the features that
    the labels select; it also reconstructs the normalized measurements, and the plane's
    boundary, uncovered places and the shape of the cloud are written beside it. With
    ``--fitted-projection``, the folder of such a run, its frozen normalization and map are
    checked against their manifest and applied. ``--coordinates`` with ``--origins`` only writes the point table.
    """
    if bool(a.performance) != bool(a.good) or sum(map(bool, (a.instances, a.features, a.coordinates))) != 1:
        raise ValueError("one of --instances, --features, --coordinates; --performance and --good together")
    if (a.features or a.coordinates) and not a.origins or a.instances and a.origins:
        raise ValueError("--origins go with --features or --coordinates")
    if a.fitted_projection and (a.performance or a.coordinates) or a.coordinates and a.performance:
        raise ValueError("a frozen map or given coordinates take no measurements")
    if a.coordinates:
        z = tables.read_indexed(spark, a.coordinates, ["z1", "z2"])
        return {"status": "coordinates_supplied", "points": _points(z, tables.read_origins(spark, a.origins, z), a.output_dir)}
    if a.instances:
        rows = adapter.audit_instances(spark, a.instances).persist()
        bad = F.size("reasons") > 0
        audit = rows.select("instance_id", "origin", F.when(bad, "needs_parameter_review").otherwise("features_available").alias("status"), F.array_join("reasons", ",").alias("reason"))
        tables.write_table(audit, f"{a.output_dir}/audit")
        rows.select("record").write.mode("errorifexists").text(f"{a.output_dir}/inputs")
        if n := rows.where(bad).count():
            return {"status": "needs_parameter_review", "bad_rows": n}
        table = tables.unique(features.all_features(rows), "instance_id").persist()
        origins = rows.select("instance_id", "origin")
    else:
        declared = [c for c in features.all_features(spark.createDataFrame([], "instance_id string, weights array<bigint>, profit array<bigint>, capacity bigint")).columns if c != "instance_id"]
        table = tables.read_features(spark, a.features, declared).persist()
        origins = tables.read_origins(spark, a.origins, table)
    tables.write_table(table, f"{a.output_dir}/features")
    if a.fitted_projection:
        fitted, weights = frozen.load(spark, a.fitted_projection)
        z = frozen.apply(table, fitted, weights).persist()
        tables.write_table(z, f"{a.output_dir}/coordinates")
        said = {"fitted_folder": a.fitted_projection, "fitted_artefacts": tables.read_json(spark, f"{a.fitted_projection}/manifest"), "selected": [*weights], "refitted": False, "coordinates_modified": False, "shape": _shape(z)}
        tables.write_json(spark, said, f"{a.output_dir}/application")
        return {"status": "frozen_projection_applied", "selected": [*weights], "points": _points(z, origins, a.output_dir)}
    fitted = {r.feature: r.asDict() for r in projection.fit_normalization(table).collect()}
    x = projection.apply_normalization(table, fitted).persist()
    tables.write_table(spark.createDataFrame([(k, *(p[c] for c in ("shift", "lambda", "anchor", "mean", "std"))) for k, p in fitted.items()], "feature string, shift double, lambda double, anchor double, mean double, std double"), f"{a.output_dir}/prelim")
    if not a.performance:
        return {"status": "waiting_for_formulation_measurements_and_sifted", "features": len(fitted)}
    responses, labels = (tables.read_indexed(spark, p, list(solve.FORMULATIONS)) for p in (a.performance, a.good))
    scales = projection.fit_responses(responses)
    y = projection.apply_normalization(responses, scales)
    joined = tables.align(x, y.withColumnsRenamed({f: f"performance_{f}" for f in scales}), labels.withColumnsRenamed({f: f"good_{f}" for f in solve.FORMULATIONS})).persist()
    chosen, info = projection.select_features(joined, list(fitted), [f"good_{f}" for f in solve.FORMULATIONS], a.seed)
    plane, back, loss = projection.pilot(joined, chosen, [f"performance_{f}" for f in scales])
    weights = dict(zip(chosen, map(tuple, plane.tolist()), strict=True))
    z = projection.project(joined, weights).persist()
    tables.write_table(z, f"{a.output_dir}/coordinates")
    tables.write_table(spark.createDataFrame([(k, *w) for k, w in weights.items()], "feature string, z1 double, z2 double"), f"{a.output_dir}/projection_matrix")
    frozen.save(spark, a.output_dir, chosen, joined)
    said = {"boundary": _boundary(joined, z, weights, a.output_dir), "shape": _shape(z), "loss": loss, "search": info["representative_search"], "responses": list(scales), "seed": a.seed}
    tables.write_json(spark, said, f"{a.output_dir}/diagnostics")
    return {"status": "projection_complete_partitions_deferred", "selected": chosen, "loss": loss, "search": info["representative_search"], "reconstruction_columns": back.shape[1], "points": _points(z, origins, a.output_dir)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="satchel", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract")
    p.add_argument("corpus"), p.add_argument("output")
    p = sub.add_parser("augment")
    p.add_argument("--parents", required=True), p.add_argument("--output-dir", required=True), p.add_argument("--max-rounds", type=int, default=100)
    p.add_argument("--candidates-per-round", type=int, default=200), p.add_argument("--seed", type=int, default=20260924), p.add_argument("--max-parents", type=int, default=0)
    p = sub.add_parser("solve")
    p.add_argument("--instances", required=True), p.add_argument("--output-dir", required=True), p.add_argument("--max-instances", type=int, default=0)
    p.add_argument("--time-limit", type=float, default=60.0)
    p = sub.add_parser("project")
    p.add_argument("--instances"), p.add_argument("--features"), p.add_argument("--origins"), p.add_argument("--coordinates"), p.add_argument("--fitted-projection")
    p.add_argument("--output-dir", required=True), p.add_argument("--performance"), p.add_argument("--good"), p.add_argument("--seed", type=int, default=0)
    a = parser.parse_args(argv)
    run = {"extract": extract, "augment": augment_, "solve": solve_, "project": project_}[a.command]
    found = run(SparkSession.builder.getOrCreate(), a)
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 2 if found.get("status") == "needs_parameter_review" else 0


if __name__ == "__main__":
    sys.exit(main())
