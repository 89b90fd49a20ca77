"""Box-Cox powers of many features at once, by aggregated moments.

A pass sends every value of a feature through all candidate powers and keeps count, mean
and squared deviation per power, merged first in the task and then across tasks. After
it the bracket of each feature closes around its best power. A feature is never gathered;
the driver sees one number per feature and power.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First candidates, candidates in a bracket of two steps, how often the bracket closes, and how often it may move beyond its end.
GRID, CLOSER, ROUNDS, MOVES = np.linspace(-8, 8, 65), 33, 4, 32
#: Values that go through the candidates at once, so that the matrix stays in the cache.
CHUNK = 512

Values = Callable[[str, np.ndarray], np.ndarray]


def merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and squared deviation of two samples together."""
    (n, x, s), (m, y, t) = a, b
    return n + m, x + (y - x) * (m / (n + m)), s + t + (y - x) ** 2 * (n * m / (n + m))


def column_moments(table: DataFrame, names: list[str], values: Values) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """By column (count, means, squared deviations) of ``values(name, x)``, a matrix with a row per value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple] = {}
        for f in frames:
            for name, x in zip(names, f.to_numpy(dtype=float).T, strict=True):
                for lo in range(0, len(x), CHUNK):
                    with np.errstate(all="ignore"):
                        y = values(name, x[lo : lo + CHUNK])
                        mean = y.mean(0)
                        y = y - mean
                        part = len(y), mean, np.einsum("ij,ij->j", y, y)
                        found[name] = merged(found[name], part) if name in found else part
        for name, (n, mean, squares) in found.items():
            yield pd.DataFrame({"feature": name, "k": np.arange(len(mean)), "n": n, "mean": mean, "m2": squares})

    plain = table.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    parts = plain.mapInPandas(run, "feature string, k int, n long, mean double, m2 double")

    def both(a, b):
        n = a["n"] + b["n"]
        apart, share = b["mean"] - a["mean"], b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    # a struct per task and power
    whole = parts.groupBy("feature", "k").agg(F.collect_list(F.struct("n", "mean", "m2")).alias("p"))
    rows = whole.select("feature", "k", F.aggregate(F.slice("p", F.lit(2), F.size("p")), F.get("p", F.lit(0)), both).alias("m")).select("feature", "k", "m.*").orderBy("feature", "k").toPandas()
    return {name: (int(f.n.iloc[0]), f["mean"].to_numpy(), f.m2.to_numpy()) for name, f in rows.groupby("feature")}


def fit_powers(table: DataFrame, names: list[str], positive: Values) -> dict[str, float]:
    """The maximum-likelihood power of each column, of whose values ``positive`` makes numbers above 0.

    With centred logarithms the likelihood falls with the variance of the transformed
    values alone. The last three candidates give the minimum by a parabola.
    """
    if not names:
        return {}
    centre = {k: m[0] for k, (_, m, _) in column_moments(table, names, lambda k, x: np.log(positive(k, x))[:, None]).items()}
    powers = dict.fromkeys(names, GRID)

    def candidates(name: str, x: np.ndarray) -> np.ndarray:
        logs, lam = np.log(positive(name, x)) - centre[name], powers[name]
        y = np.outer(logs, lam)
        np.expm1(y, out=y)
        y /= np.where(lam == 0, 1, lam)
        y[:, lam == 0] = logs[:, None]
        return y

    best, rounds = {}, dict.fromkeys(names, 0)
    for _ in range(ROUNDS + 1 + MOVES):
        open_ = [k for k in names if rounds[k] <= ROUNDS]
        if not open_:
            break
        for name, (n, _, squares) in column_moments(table, open_, candidates).items():
            with np.errstate(all="ignore"):
                loss = np.where(np.isfinite(squares) & (squares > 0), np.log(squares / n), np.inf)
            lam, k = powers[name], int(np.argmin(loss))
            best[name] = lam[k]
            if k in (0, len(lam) - 1) and np.isfinite(loss[k]):
                powers[name] = lam[k] + 2 * (lam - lam[len(lam) // 2])  # the best may lie beyond: wider steps around the end
                continue
            if np.isfinite(loss[k - 1 : k + 2]).all() and (bend := loss[k - 1] - 2 * loss[k] + loss[k + 1]) > 0:
                best[name] += (lam[k + 1] - lam[k]) / 2 * (loss[k - 1] - loss[k + 1]) / bend
            powers[name] = np.linspace(lam[max(k - 1, 0)], lam[min(k + 1, len(lam) - 1)], CLOSER)
            rounds[name] += 1
    return {k: float(v) for k, v in best.items()}
