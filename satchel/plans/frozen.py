"""Fitted maps kept with a manifest of fingerprints, and checked before they are applied.

A fit leaves the normalization, the map, the normalized features that it was fitted on,
their coordinates and a summary. The manifest chains them by sha256, so a map is applied
only together with the normalization it was fitted with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.plans import projection
from satchel.sources import tables

ARTEFACTS = ("prelim", "projection_matrix", "selected_features", "coordinates", "summary")
KIND = {"problem": "KP", "variant": "domain"}
NORMALIZATION = ["shift", "lambda", "anchor", "mean", "std"]


def sign(spark: SparkSession, folder: str, mode: str = "errorifexists") -> None:
    """Writes the manifest of the artefacts as they are."""
    tables.write_json(spark, {name: tables.folder_digest(spark, f"{folder}/{name}") for name in ARTEFACTS}, f"{folder}/manifest", mode)


def save(spark: SparkSession, folder: str, selected: list[str], normalized: DataFrame, index: str = "instance_id") -> None:
    """Adds what makes a fit whose normalization, map and coordinates are in ``folder`` a frozen one."""
    tables.write_table(normalized.select(index, *selected), f"{folder}/selected_features")
    tables.write_json(spark, KIND | {"projection_fitted": True, "projection_modified": False, "selected": selected}, f"{folder}/summary")
    sign(spark, folder)


def _finite(rows: DataFrame, names: list[str]) -> bool:
    bad = F.lit(False)
    for c in names:
        bad = bad | ~F.coalesce((F.abs(f"`{c}`") < float("inf")) & ~F.isnan(f"`{c}`"), F.lit(False))
    return rows.where(bad).head(1) == []


def load(spark: SparkSession, folder: str, index: str = "instance_id") -> tuple[dict[str, dict[str, float]], dict[str, tuple[float, float]]]:
    """(normalization, map) by feature, in the order of the fit. Raises unless

    the artefacts are those of the manifest; the fit is of this problem and form; the map
    was fitted and not changed since; it holds the declared features; so do the training
    features, with the ids of the coordinates; all numbers are finite; the coordinates are
    those of the map to 1e-10; every feature has a normalization.
    """
    said = tables.read_json(spark, f"{folder}/manifest")
    if changed := [n for n in ARTEFACTS if said.get(n) != tables.folder_digest(spark, f"{folder}/{n}")]:
        raise ValueError(f"artefacts changed since the fit: {changed}")
    summary = tables.read_json(spark, f"{folder}/summary")
    if {k: summary.get(k) for k in KIND} != KIND:
        raise ValueError("the map was fitted for another problem or form")
    if summary.get("projection_fitted") is not True or summary.get("projection_modified") is not False:
        raise ValueError("the map was not fitted, or was changed afterwards")
    selected = summary["selected"]
    matrix = tables.read_indexed(spark, f"{folder}/projection_matrix", ["z1", "z2"], "feature")
    weights = {r.feature: (r.z1, r.z2) for r in matrix.collect()}  # a row per feature
    if {*weights} != {*selected}:
        raise ValueError("the map and the declared features disagree")
    header = spark.read.csv(f"{folder}/selected_features", header=True).columns
    if header != [index, *selected]:
        raise ValueError("the training features and the declared ones disagree")
    x, z = tables.read_indexed(spark, f"{folder}/selected_features", selected, index), tables.read_indexed(spark, f"{folder}/coordinates", ["z1", "z2"], index)
    tables.require_same_ids(x, z, index)
    if not (_finite(matrix, ["z1", "z2"]) and _finite(x, selected) and _finite(z, ["z1", "z2"])):
        raise ValueError("the frozen artefacts must be finite")
    weights = {k: weights[k] for k in selected}
    projection.verify_projection(x, weights, z, index=index)
    frozen = {r.feature: r.asDict() for r in tables.read_indexed(spark, f"{folder}/prelim", NORMALIZATION, "feature").collect()}
    if missing := [k for k in selected if k not in frozen]:
        raise ValueError(f"features of the map without a normalization: {missing}")
    return {k: frozen[k] for k in selected}, weights


def apply(features: DataFrame, fitted: dict[str, dict[str, float]], weights: dict[str, tuple[float, float]]) -> DataFrame:
    """(instance_id, z1, z2) of all rows; there must be some, with every feature of the map."""
    if not features.head(1):
        raise ValueError("no instances")
    return projection.project(projection.apply_normalization(features, fitted), weights)
