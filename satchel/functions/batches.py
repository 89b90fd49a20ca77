"""Statistics of array columns on Arrow batches: rows with lists of one length are a matrix.

The same rules as ``functions.arrays``; sums run in the same order, element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from satchel.functions.arrays import SEVEN, TIE_BREAK

#: Numbers of a matrix of rows and pairs or triples, at most (unless one row has more).
MOST_NUMBERS = 1_000_000
Columns = dict[str, np.ndarray]


class Lists:
    """A list column as doubles; ``sound`` says which lists are there and hold no null."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.values = pc.fill_null(flat.cast(pa.float64(), safe=False), np.nan).to_numpy(zero_copy_only=False)
        self.sound = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
        if flat.null_count:
            at = np.repeat(np.arange(len(column)), self.lengths)
            self.sound[at[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False

    def matrix(self, rows: np.ndarray, n: int) -> np.ndarray:
        return self.values[self.starts[rows][:, None] + np.arange(n)]


def same_length(lists: list[Lists], good: np.ndarray, numbers: Callable[[int], int]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, a matrix for each list column) for the good rows, whose lists must be sound and of one length.

    ``numbers``: how many numbers a row with n elements takes; rows are cut by it.
    """
    lengths = lists[0].lengths
    for x in lists:
        good = good & x.sound & (x.lengths == lengths)
    for n in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == n))
        step = max(1, MOST_NUMBERS // max(1, numbers(n)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, [x.matrix(part, n) for x in lists]


def by_batches(df: DataFrame, index: str, inputs: list[str], names: list[str], compute: Callable[..., Iterator[tuple[np.ndarray, Columns]]]) -> DataFrame:
    """``index`` and the double columns ``names``.

    ``compute`` takes the batch's input columns and yields (rows, values by name); what it
    does not give is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((len(names), batch.num_rows))
            given = np.zeros((len(names), batch.num_rows), bool)
            for rows, found in compute(*(batch.column(i + 1) for i in range(len(inputs)))):
                for i, name in enumerate(names):
                    if name in found:
                        values[i, rows], given[i, rows] = found[name], True
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, mask=~g) for v, g in zip(values, given, strict=True))], [index, *names])

    schema = StructType([df.schema[index], *(StructField(c, DoubleType()) for c in names)])
    return df.select(index, *inputs).mapInArrow(run, schema)


def total(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for column in x.T:
        out += column
    return out


def centred(x: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    return total((x - mean[:, None]) ** k) / x.shape[1]


def quantile(ordered: np.ndarray, q: float) -> np.ndarray:
    at = (ordered.shape[1] - 1) * q
    low = int(at)
    first, second = ordered[:, low], ordered[:, min(low + 1, ordered.shape[1] - 1)]
    return first + (second - first) * (at - low)


def divided(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
    """a / b, 0 elsewhere."""
    return np.divide(a, b, out=np.zeros(len(a)), where=where)


def stats(prefix: str, x: np.ndarray) -> Columns:
    """The 15 statistics of each row."""
    s, n = np.sort(x, axis=1), x.shape[1]
    m = total(x) / n
    v = centred(x, m, 2)
    d = np.sqrt(v)
    moved = d > 1e-12
    values = {
        "count": np.full(len(x), float(n)), "mean": m, "var": v, "std": d, "min": s[:, 0], "max": s[:, -1], "q25": quantile(s, 0.25), "median": quantile(s, 0.5), "q75": quantile(s, 0.75),
        "zero_ratio": (x == 0).sum(1) / n, "negative_ratio": (x < 0).sum(1) / n, "unique_ratio": (1 + (s[:, 1:] != s[:, :-1]).sum(1)) / n, "cv": divided(d, np.abs(m), np.abs(m) > 1e-12),
        "skew": divided(centred(x, m, 3), d * d * d, moved), "kurtosis": np.where(moved, divided(centred(x, m, 4), d * d * d * d, moved) - 3, 0.0),
    }
    return {f"{prefix}_{k}": value for k, value in values.items()}


def seven(prefix: str, x: np.ndarray) -> Columns:
    """The seven-number summary of each row; of empty ones all 0."""
    if not x.shape[1]:
        return {f"{prefix}_{k}": np.zeros(len(x)) for k in SEVEN}
    s = np.sort(x, axis=1)
    m = total(s) / x.shape[1]
    values = {f"q{round(100 * q):02d}": quantile(s, q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)} | {"mean": m, "std": np.sqrt(centred(s, m, 2))}
    return {f"{prefix}_{k}": value for k, value in values.items()}


def gini(x: np.ndarray) -> np.ndarray:
    """Gini coefficient by ranks; 0 if the sum is."""
    s, n = np.sort(x, axis=1), x.shape[1]
    t = total(s)
    return np.where(t > 0, 2 * divided(total(s * np.arange(1, n + 1)), n * t, t > 0) - (n + 1) / n, 0.0)


def midranks(x: np.ndarray) -> np.ndarray:
    """Mean zero-based rank of each element among its row, ties shared."""
    other, own = x[:, None, :], x[:, :, None]
    return (other < own).sum(2) + ((other == own).sum(2) - 1) / 2


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation; 0 if either is constant."""
    n = x.shape[1]
    mx, my = total(x) / n, total(y) / n
    cross = total((x - mx[:, None]) * (y - my[:, None]))
    norms = np.sqrt(centred(x, mx, 2) * n) * np.sqrt(centred(y, my, 2) * n)
    return divided(cross, norms, ~constant(x) & ~constant(y))


def constant(x: np.ndarray) -> np.ndarray:
    return x.min(1) == x.max(1)


def seven_digits(x: np.ndarray) -> np.ndarray:
    """The rule of ``arrays.sig7``; numbers near the middle of two results, or out of range, go by their text."""
    y = np.where(np.abs(x) < 1e-9, 0.0, x * TIE_BREAK)
    out, size = y.copy(), np.abs(y)
    at = np.flatnonzero((y != 0) & np.isfinite(y))
    k = 6 - np.floor(np.log10(size[at])).astype(np.int64)
    fine = np.abs(k) <= 22
    power = 10.0 ** np.where(fine, np.abs(k), 0)  # a double exactly
    scaled = np.where(k >= 0, size[at] * power, size[at] / power)
    whole = np.rint(scaled)
    fine &= (scaled >= 1e6) & (scaled < 1e7) & (np.abs(np.abs(scaled - whole) - 0.5) > 1e-6)
    out[at] = np.copysign(np.where(k >= 0, whole / power, whole * power), y[at])
    for i in at[~fine].tolist():
        out[i] = float(f"{y[i]:.6e}")
    return out


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to seven significant digits, for comparison between engines."""
    chosen = [t == "double" for _, t in df.dtypes]
    if not any(chosen):
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for column, double in zip(batch.columns, chosen, strict=True):
                if double:
                    empty = pc.is_null(column).to_numpy(zero_copy_only=False)
                    column = pa.array(seven_digits(pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)), mask=empty)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
