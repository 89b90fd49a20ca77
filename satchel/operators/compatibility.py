"""Which items of a packing instance fit a bin together: features of pairs and triples, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions import batches
from satchel.functions.arrays import SEVEN

TINY = 1e-12
NAMES = [f"compat_{p}_{k}" for p in ("pair", "triple") for k in ("fit_ratio", "exact_fit_ratio", "feasible_slack_mean", "feasible_slack_std")] + ["compat_no_partner_item_ratio", "compat_size_gini"] + [
    f"compat_{p}_{k}" for p in ("partner_fraction", "sorted_size_gap", "best_pair_slack") for k in SEVEN
]
#: Fixed value: the most items for which triples are looked at.
MOST_ITEMS = 400


def triples(x: Column, f) -> Column:
    """f(a, b, c) for the elements i < j < k of an array."""
    n = F.size(x)
    last = lambda a, b, k: F.transform(F.slice(x, k, n), lambda c: f(a, b, c))
    return F.flatten(F.transform(x, lambda a, i: F.flatten(F.transform(F.slice(x, i + 2, n), lambda b, j: last(a, b, i + j + 3)))))


def _slack(name: str, s: np.ndarray) -> batches.Columns:
    """The four features of the slacks of pairs or triples; of none all 0."""
    fits, m = s >= -TINY, max(s.shape[1], 1)
    many, left = fits.sum(1), np.where(fits, s, 0.0).clip(0)
    mean = batches.divided(batches.total(left), many, many > 0)
    apart = np.where(fits, left - mean[:, None], 0.0)
    return {
        f"compat_{name}_fit_ratio": many / m, f"compat_{name}_exact_fit_ratio": (np.abs(s) <= TINY).sum(1) / m,
        f"compat_{name}_feasible_slack_mean": mean, f"compat_{name}_feasible_slack_std": np.sqrt(batches.divided(batches.total(apart * apart), many, many > 0)),
    }


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places i < j < k, in this order."""
    i, j = np.triu_indices(n, 1)
    many = n - 1 - j
    at = np.repeat(np.arange(len(i)), many)
    return i[at], j[at], j[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)


def _sevens(name: str, x: np.ndarray, there: np.ndarray) -> batches.Columns:
    """The seven numbers of the elements that are there, which differ in number from row to row."""
    out = {f"compat_{name}_{k}": np.zeros(len(x)) for k in SEVEN}
    ordered, many = np.sort(np.where(there, x, np.inf), axis=1), there.sum(1)
    for n in np.unique(many).tolist():
        rows = many == n
        for k, v in batches.seven(f"compat_{name}", ordered[rows, :n]).items():
            out[k][rows] = v
    return out


def _compatibility(r: np.ndarray) -> batches.Columns:
    n = r.shape[1]
    i, j = np.triu_indices(n, 1)
    a, b, c = _triples(n)
    room = 1.0 - r[:, :, None] - r[:, None, :]
    fits = (room >= -TINY) & ~np.eye(n, dtype=bool)
    partners = fits.sum(2)
    ordered, everywhere = np.sort(r, axis=1), np.ones((len(r), n), bool)
    out = _slack("pair", 1.0 - r[:, i] - r[:, j]) | _slack("triple", 1.0 - (r[:, a] + r[:, b] + r[:, c]))
    out |= {"compat_no_partner_item_ratio": (partners == 0).sum(1) / n, "compat_size_gini": batches.gini(r)}
    best = np.where(fits, room, np.inf).min(2).clip(0)
    return out | _sevens("partner_fraction", partners / max(n - 1, 1), everywhere) | _sevens("sorted_size_gap", np.diff(ordered, axis=1), everywhere[:, 1:]) | _sevens("best_pair_slack", best, partners > 0)


def compatibility_features(instances: DataFrame) -> DataFrame:
    """The 31 features of the items' pairs and triples, a row per instance; nothing is shuffled.

    ``instances``: instance_id, sizes, capacity. Without items, without a capacity above 0
    and above MOST_ITEMS items there is no row; of sizes with a null all features are null.
    """
    rows = instances.where(F.size("sizes").between(1, MOST_ITEMS) & (F.col("capacity") > 0))
    df = rows.select("instance_id", F.col("sizes"), F.col("capacity").cast("double").alias("capacity"))

    def compute(sizes: pa.Array, capacity: pa.Array) -> Iterator[tuple[np.ndarray, batches.Columns]]:
        c = capacity.to_numpy(zero_copy_only=False)
        # The triples' slacks and the arrays made of them.
        for at, (x,) in batches.same_length([batches.Lists(sizes)], np.ones(len(c), bool), lambda n: n * n + n**3 // 6):
            yield at, _compatibility(x / c[at][:, None])

    return batches.by_batches(df, "instance_id", ["sizes", "capacity"], NAMES, compute)
