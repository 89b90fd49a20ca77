"""Knapsack features: 61 of the items' distributions and 39 of their relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions import batches
from satchel.functions.arrays import SEVEN, STATS

DOMAIN = [f"{p}_{s}" for p in ("weights", "profit", "capacity") for s in STATS] + ["capacity_total_weight_ratio"] + [f"profit_weight_ratio_{s}" for s in STATS]
RELATION = [f"kp_{p}_{s}" for p in ("relative_weight", "relative_value_density", "pair_slack", "partner_fraction") for s in SEVEN] + [
    "kp_weight_gini", "kp_profit_gini", "kp_weight_profit_pearson", "kp_weight_profit_spearman", "kp_weight_profit_correlation_undefined",
    "kp_pair_fit_ratio", "kp_pair_exact_fit_ratio", "kp_pair_lower_weight_higher_profit_ratio", "kp_identical_item_pair_ratio",
    "kp_oversize_item_ratio", "kp_zero_profit_item_ratio",
]


def _pairs(w: np.ndarray, p: np.ndarray, c: np.ndarray) -> batches.Columns:
    """Pairs are at most 19,900 per row."""
    r, n = w / c[:, None], w.shape[1]
    slack = 1.0 - r[:, :, None] - r[:, None, :]
    fits = (slack >= -1e-12).sum(2) - (np.diagonal(slack, axis1=1, axis2=2) >= -1e-12)
    i, j = np.triu_indices(n, 1)
    s = slack[:, i, j]
    wi, wj, pi, pj = w[:, i], w[:, j], p[:, i], p[:, j]
    ratio = lambda x: x.sum(1) / max(len(i), 1)
    return batches.seven("kp_pair_slack", s) | batches.seven("kp_partner_fraction", fits / max(n - 1, 1)) | {
        "kp_pair_fit_ratio": ratio(s >= -1e-12), "kp_pair_exact_fit_ratio": ratio(np.abs(s) <= 1e-12),
        "kp_pair_lower_weight_higher_profit_ratio": ratio(((wi < wj) & (pi > pj)) | ((wi > wj) & (pi < pj))), "kp_identical_item_pair_ratio": ratio((wi == wj) & (pi == pj)),
    }


def _density(w: np.ndarray, p: np.ndarray, c: np.ndarray) -> batches.Columns:
    d = p / w
    mean = batches.total(d) / w.shape[1]
    return batches.seven("kp_relative_value_density", np.divide(d, mean[:, None], out=np.zeros_like(d), where=mean[:, None] > 0))


#: Features that are computed together: (beginning of their names, the step).
STEPS: list[tuple[tuple[str, ...], Callable[..., batches.Columns]]] = [
    (("weights_",), lambda w, p, c: batches.stats("weights", w)),
    (("profit_weight_ratio_",), lambda w, p, c: batches.stats("profit_weight_ratio", p / w)),
    (("profit_",), lambda w, p, c: batches.stats("profit", p)),
    (("capacity_total_weight_ratio",), lambda w, p, c: {"capacity_total_weight_ratio": c / batches.total(w)}),
    (("capacity_",), lambda w, p, c: batches.stats("capacity", c[:, None])),
    (("kp_relative_weight_",), lambda w, p, c: batches.seven("kp_relative_weight", w / c[:, None])),
    (("kp_relative_value_density_",), _density),
    (("kp_pair_", "kp_partner_fraction_", "kp_identical_item_pair_ratio"), _pairs),
    (("kp_weight_gini",), lambda w, p, c: {"kp_weight_gini": batches.gini(w)}),
    (("kp_profit_gini",), lambda w, p, c: {"kp_profit_gini": batches.gini(p)}),
    (("kp_weight_profit_pearson",), lambda w, p, c: {"kp_weight_profit_pearson": batches.pearson(w, p)}),
    (("kp_weight_profit_spearman",), lambda w, p, c: {"kp_weight_profit_spearman": batches.pearson(batches.midranks(w), batches.midranks(p))}),
    (("kp_weight_profit_correlation_undefined",), lambda w, p, c: {"kp_weight_profit_correlation_undefined": (batches.constant(w) | batches.constant(p)).astype(float)}),
    (("kp_oversize_item_ratio",), lambda w, p, c: {"kp_oversize_item_ratio": (w / c[:, None] > 1 + 1e-12).sum(1) / w.shape[1]}),
    (("kp_zero_profit_item_ratio",), lambda w, p, c: {"kp_zero_profit_item_ratio": (p == 0).sum(1) / p.shape[1]}),
]


def chosen_features(instances: DataFrame, names: list[str]) -> DataFrame:
    """instance_id and the features ``names``, of the 100; only the steps that give them are taken. Nulls as in ``domain_features``."""
    if unknown := set(names) - {*DOMAIN, *RELATION}:
        raise ValueError(f"no such features: {sorted(unknown)}")
    parts = [STEPS[k][1] for k in sorted({next(k for k, (begins, _) in enumerate(STEPS) if name.startswith(begins)) for name in names})]

    def compute(weights: pa.Array, profit: pa.Array, capacity: pa.Array) -> Iterator[tuple[np.ndarray, batches.Columns]]:
        c = capacity.to_numpy(zero_copy_only=False)
        for rows, (w, p) in batches.same_length([batches.Lists(weights), batches.Lists(profit)], ~np.isnan(c), lambda n: n * n):
            if not w.shape[1] or (w == 0).any() or (c[rows] == 0).any():
                raise ZeroDivisionError("an instance without items, or a weight or capacity of 0")
            found: batches.Columns = {}
            for part in parts:
                found |= part(w, p, c[rows])
            yield rows, found

    return batches.by_batches(instances.withColumn("capacity", F.col("capacity").cast("double")), "instance_id", ["weights", "profit", "capacity"], names, compute)


def domain_features(instances: DataFrame) -> DataFrame:
    """instance_id and the 61 DOMAIN features, all of a row, so nothing is shuffled.

    Features are null where a list or the capacity is null, where a list holds a null and
    where the lists differ in length; a weight or capacity of 0 raises.
    """
    return chosen_features(instances, DOMAIN)


def pairs(x, f):
    """f(a, b) for the pairs of elements i < j of an array."""
    return F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: f(a, b))))


def relation_features(instances: DataFrame) -> DataFrame:
    """instance_id and the 39 RELATION features; nulls as in ``domain_features``."""
    return chosen_features(instances, RELATION)


def all_features(instances: DataFrame) -> DataFrame:
    """instance_id and all 100 features, in one pass."""
    return chosen_features(instances, DOMAIN + RELATION)


def feature_means(features: DataFrame) -> DataFrame:
    """(feature, rows, mean, not_finite) of double columns, a row each; sums of batches are added up.

    Null values count as rows, not in the mean.
    """
    names = [c for c, t in features.dtypes if t == "double"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            there = [c.drop_null().to_numpy() for c in part.columns]
            given = [np.array(x) for x in ([len(c) for c in there], [float(c.sum()) for c in there], [int((~np.isfinite(c)).sum()) for c in there])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([part.num_rows] * len(names)), *map(pa.array, given)], ["feature", "rows", "given", "sum", "not_finite"])

    sums = features.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, "feature string, rows long, given long, sum double, not_finite long")
    return sums.groupBy("feature").agg(F.sum("rows").alias("rows"), F.try_divide(F.sum("sum"), F.sum("given")).alias("mean"), F.sum("not_finite").alias("not_finite"))


def long_features(features: DataFrame, index: str = "instance_id") -> DataFrame:
    """(instance_id, feature, value)."""
    names = [c for c in features.columns if c != index]
    return features.unpivot([index], names, "feature", "value")
