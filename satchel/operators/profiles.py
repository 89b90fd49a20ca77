"""Features of linear models, schedules, transports and typed profiles for many instances at a time.

The families are those of ``families``, with the same names, values and order. A field is
an array column (or a column of rows, for matrices); a batch of instances is computed with
whole-array operations over the values of all of them, a task per part of the table.
Instances that break a rule of their family, or whose numbers are missing or not finite,
go through the family's own function, which says why.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from satchel.functions.arrays import STATS
from satchel.operators import families

TINY = families.TINY


class Lists:
    """Arrays of different lengths, one after another; ``width`` is the number of columns of each, if they are matrices."""

    def __init__(self, values: np.ndarray, count: np.ndarray, width: np.ndarray | None = None):
        self.values, self.count, self.width = values, count, width
        self.end = np.cumsum(count)
        self.begin = self.end - count

    @property
    def who(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def sum(self, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.who, self.values if values is None else values, len(self.count))

    def like(self, values: np.ndarray) -> Lists:
        return Lists(values, self.count, self.width)


Found = dict[str, np.ndarray]


def stats(name: str, x: Lists) -> Found:
    """The 15 statistics of each array; none is empty."""
    n, who = x.count, x.who
    s = x.values[np.lexsort((x.values, who))]
    mean = x.sum(s) / n
    apart = s - mean[who]
    var = x.sum(apart * apart) / n
    d = np.sqrt(var)
    z = apart * np.where(d > TINY, 1 / np.where(d > TINY, d, 1), 0)[who]
    square = z * z
    skew, kurtosis = x.sum(square * z) / n, np.where(d > TINY, x.sum(square * square) / n - 3, 0)
    new = np.r_[True, s[1:] != s[:-1]]
    new[x.begin] = True
    cv = np.where(np.abs(mean) > TINY, d / np.where(np.abs(mean) > TINY, np.abs(mean), 1), 0)

    def quantile(q: float) -> np.ndarray:
        at = q * (n - 1)
        low = at.astype(np.int64)
        first = s[x.begin + low]
        return first + (s[x.begin + np.minimum(low + 1, n - 1)] - first) * (at - low)

    found = (n.astype(float), mean, var, d, s[x.begin], s[x.end - 1], *map(quantile, (0.25, 0.5, 0.75)), x.sum(s == 0) / n, x.sum(s < 0) / n, x.sum(new) / n, cv, skew, kurtosis)
    return {f"{name}_{k}": v for k, v in zip(STATS, found, strict=True)}


def sides(a: Lists) -> tuple[Lists, Lists]:
    """The sums of each matrix's rows and of its columns."""
    rows = a.count // a.width
    cell, width, who = np.arange(len(a.values)) - np.repeat(a.begin, a.count), np.repeat(a.width, a.count), a.who
    out = []
    for count, at in ((rows, cell // width), (a.width, cell % width)):
        start = np.cumsum(count) - count
        out.append(Lists(np.bincount(start[who] + at, a.values, int(count.sum())), count))
    return out[0], out[1]


def matrix_features(name: str, a: Lists, by: tuple[Lists, Lists] | None = None) -> Found:
    by = by or sides(a)

    def spread(x: Lists) -> np.ndarray:
        mean = x.sum() / x.count
        return np.sqrt(x.sum((x.values - mean[x.who]) ** 2) / x.count) / np.maximum(x.sum(np.abs(x.values)) / x.count, TINY)

    return stats(name, a) | {f"{name}_rows": (a.count // a.width).astype(float), f"{name}_columns": a.width.astype(float), f"{name}_density": a.sum(a.values != 0) / a.count, f"{name}_row_sum_cv": spread(by[0]), f"{name}_col_sum_cv": spread(by[1])}


def _each(d: dict, *names: str) -> Found:
    return {k: v for n in names for k, v in stats(n, d[n]).items()}


def _one(x: np.ndarray) -> Lists:
    return Lists(x, np.ones(len(x), np.int64))


def _const(like: np.ndarray, v: float) -> np.ndarray:
    return np.full(len(like), v)


def fleet(d: dict) -> Found:
    could = d["capacity"].like(d["capacity"].values * d["vehicle_upper_bounds"].values)
    out = _each(d, "cost", "capacity") | stats("demand", _one(d["demand"])) | _each(d, "vehicle_upper_bounds")
    return out | stats("available_transport_capacity", could) | {"demand_available_capacity_ratio": d["demand"] / could.sum(), "integer_vehicle_domain": _const(d["demand"], 1.0)}


def energy(d: dict) -> Found:
    low, high, a = d["minimum_output"], d["output_capacity"], d["coupling_coefficients"]
    least, most, whole = d["supply_lower_bound"], d["supply_upper_bound"], high.sum()
    out = _each(d, "unit_cost", "minimum_output", "output_capacity") | stats("supply_lower_bound", _one(least)) | stats("supply_upper_bound", _one(most))
    return out | stats("adjustable_output", high.like(high.values - low.values)) | stats("physical_coupling_coefficient", a) | stats("physical_coupling_rhs", d["coupling_rhs"]) | {
        "physical_coupling_count": (a.count // a.width).astype(float), "physical_coupling_density": a.sum(a.values != 0) / a.count, "demand_total_capacity_ratio": least / whole,
        "minimum_total_capacity_ratio": low.sum() / whole, "supply_interval_capacity_ratio": (most - least) / whole, "continuous_output_domain": _const(whole, 1.0),
    }


def product_mix(d: dict) -> Found:
    usage, limit, c = d["resource_usage"], d["production_limit"], d["capacity"]
    share, most = usage.values / c[usage.who], usage.values * limit.values
    out = {"item_count": d["profit"].count.astype(float), "resource_capacity": c, "total_maximum_resource_share": usage.sum(most) / c}
    return out | _each(d, "profit", "resource_usage", "production_limit") | stats("unit_resource_share", usage.like(share)) | stats("maximum_resource_share", usage.like(most / c[usage.who]))


def stated_milp(d: dict) -> Found:
    low, top = d["lower_bounds"], d["upper_bounds"]
    out = matrix_features("input_coefficients", d["coefficients"]) | stats("input_rhs", d["rhs"]) | stats("input_objective", d["objective"]) | stats("input_lower_bound", low)
    out |= stats("stated_upper_bound", top) | stats("stated_bound_width", top.like(top.values - low.values))
    equal = np.array([sum(s == "==" for s in x) / len(x) for x in d["relation_senses"]])
    return out | {"input_equality_fraction": equal, "input_objective_is_minimization": np.array([float(s == "min") for s in d["objective_sense"]])}


def shop(d: dict) -> Found:
    by = sides(d["processing_time"])
    return matrix_features("processing_time", d["processing_time"], by) | stats("job_load", by[0]) | stats("machine_load", by[1])


def transport(d: dict) -> Found:
    return matrix_features("cost", d["cost"]) | _each(d, "supply", "demand") | {"supply_demand_ratio": d["supply"].sum() / d["demand"].sum()}


def facility(d: dict) -> Found:
    return matrix_features("cost", d["cost"]) | _each(d, "capacity", "demand", "fixed_cost")


def landing(d: dict) -> Found:
    names = ("earliest", "target", "latest", "early_penalty", "late_penalty")
    return _each(d, *names) | stats("window_width", d["latest"].like(d["latest"].values - d["earliest"].values))


def profile(d: dict) -> Found:
    """Variants without matrices; all instances of a batch are of one variant."""
    variant = d["variant"][0]
    rule, out = families.PROFILES.get(variant, {}), {}
    for name, v in d.items():
        if name != "variant":
            out |= stats(name, v if isinstance(v, Lists) else _one(v))
    if "ratio" in rule:
        name, a, b = rule["ratio"]
        out |= stats(name, d[a].like(d[a].values / d[b][d[a].who]))
    if "sums" in rule:
        name, a, b = rule["sums"]
        out[name] = d[a].sum() / d[b].sum()
    return out


BATCHES: dict[str, Callable[[dict], Found]] = {"fleet": fleet, "energy": energy, "product_mix": product_mix, "stated_milp": stated_milp, "job_shop": shop, "flow_shop": shop, "transport": transport, "facility": facility, "landing": landing, "profile": profile}


def _fields(family: str, column: pa.StructArray) -> tuple[dict, np.ndarray]:
    """The fields of a batch's instances, and which instances are plain.

    Plain: all numbers there, finite and above 0 (in matrices 0 too), arrays of one length,
    matrices of that many columns, and of as many rows where these have fields of their own.
    Such instances break no rule of a family but those that ``_ordered`` checks.
    """
    n, out = len(column), {}
    plain, length = np.ones(n, bool), None
    for field, x in zip(column.type, column.flatten(), strict=True):
        width = height = None
        if pa.types.is_string(field.type) or (pa.types.is_list(field.type) and pa.types.is_string(field.type.value_type)):
            out[field.name] = x.to_pylist()
            plain &= np.array([bool(v) and all(v) and (isinstance(v, str) or set(v) <= {"<=", "=="}) for v in out[field.name]], bool)
            continue
        count = np.ones(n, np.int64)
        if pa.types.is_list(field.type):
            count = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            plain &= count > 0
            x = x.flatten()
            if pa.types.is_list(field.type.value_type):
                inner, rows = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), Lists(np.empty(0), count)
                total, most = rows.sum(inner).astype(np.int64), np.zeros(n, np.int64)
                np.maximum.at(most, rows.who, inner)
                plain &= total == count * most
                height, count, width, x = count, total, np.maximum(most, 1), x.flatten()
                plain &= count > 0
        values = x.cast(pa.float64()).to_numpy(zero_copy_only=False)
        lists = Lists(values, count, width)
        with np.errstate(invalid="ignore"):
            plain &= lists.sum(~(np.isfinite(values) & (values > 0 if width is None else values >= 0))) == 0
        out[field.name] = lists if pa.types.is_list(field.type) else values
        if isinstance(out[field.name], Lists) and not field.name.endswith("rhs"):
            size = count if width is None else width
            length = size if length is None else length
            plain &= size == length
            if height is not None and family in ("transport", "facility"):
                plain &= height == length
    return out, plain


def _ordered(family: str, d: dict) -> np.ndarray:
    """Of plain instances, which have bounds in order and rows of one number, and are of the first one's profile."""
    ok, pairs = np.array(True), {"landing": (("earliest", "target"), ("target", "latest")), "stated_milp": (("lower_bounds", "upper_bounds"),)}.get(family, ())
    if family == "stated_milp":
        rows = d["coefficients"].count // d["coefficients"].width
        ok = (rows == d["rhs"].count) & (rows == np.array([len(x) for x in d["relation_senses"]]))
    if family == "profile":
        rule = families.PROFILES.get(d["variant"][0], {})
        ok = np.array([v == d["variant"][0] and "matrix" not in rule for v in d["variant"]])
        pairs = (rule["ordered"],) if "ordered" in rule else ()
    for a, b in pairs:
        ok = ok & (d[a].sum(d[a].values > d[b].values) == 0)
    return ok


def batch_features(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(instance_id, part, family, features, reason), a row per instance and column: ``features`` holds the values in the family's order.

    ``columns``: struct columns of ``rows`` with the fields of a family, and the family of
    each; ``part`` is the column's name. Square matrices, arrays of one length and numbers
    above 0 are computed together; any other instance by its family's own function.
    """
    names = list(columns)

    def alone(family: str, payload: dict) -> tuple[list | None, str | None]:
        try:
            found = families.FAMILIES[family](payload)
        except (families.Unsupported, KeyError, TypeError, ValueError, IndexError, ZeroDivisionError) as error:
            return None, f"{type(error).__name__}: {error}"
        bad = [k for k, v in found.items() if not math.isfinite(v)]
        return (None, f"nonfinite: {bad[0]}") if bad else ([float(v) for v in found.values()], None)

    def found_in(family: str, x: pa.StructArray) -> tuple[pa.Array, pa.Array]:
        """(features, reason) of the instances of one column."""
        d, plain = _fields(family, x)
        if plain.all() and np.all(_ordered(family, d)):
            found = np.stack(list(BATCHES[family](d).values()), 1)
            if np.isfinite(found).all():
                ends = np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]
                return pa.ListArray.from_arrays(ends, found.ravel()), pa.nulls(len(x), pa.string())
        if len(x) > 1 and plain.any():  # the plain ones together, the others one by one
            ok = np.flatnonzero(plain)
            if len(ok) < len(x):
                parts = [(at, found_in(family, x.take(pa.array(at)))) for at in (ok, np.flatnonzero(~plain))]
            else:  # out of order or not finite: halves
                parts = [(at, found_in(family, x.take(pa.array(at)))) for at in np.array_split(np.arange(len(x)), 2)]
            back = pa.array(np.argsort(np.concatenate([at for at, _ in parts])))
            return tuple(pa.concat_arrays([r[i] for _, r in parts]).take(back) for i in (0, 1))
        got = [alone(family, {k: v for k, v in (r or {}).items() if v is not None}) for r in x.to_pylist()]
        return pa.array([v for v, _ in got], pa.list_(pa.float64())), pa.array([r for _, r in got], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in names:
                values, reason = found_in(columns[name], b[name])
                yield pa.RecordBatch.from_arrays([b["instance_id"], *(pa.array([v] * len(b), pa.string()) for v in (name, columns[name])), values, reason], names=["instance_id", "part", "family", "features", "reason"])

    return rows.select("instance_id", *names).mapInArrow(run, "instance_id string, part string, family string, features array<double>, reason string")
