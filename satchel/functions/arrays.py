"""Statistics of array columns as column expressions: one row per instance, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("count", "mean", "var", "std", "min", "max", "q25", "median", "q75", "zero_ratio", "negative_ratio", "unique_ratio", "cv", "skew", "kurtosis")
TIE_BREAK = 1.000000003
SEVEN = ("q00", "q25", "q50", "q75", "q100", "mean", "std")


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def share(x: Column, test: Callable[[Column], Column]) -> Column:
    """The share of elements that pass."""
    return F.size(F.filter(x, test)) / F.size(x)


def quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation between the elements of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    first, second = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return first + (second - first) * (at - low)


def centred_power(x: Column, mean: Column, k: int) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(float(k)))) / F.size(x)


def with_stats(df: DataFrame, prefix: str, x: Column) -> DataFrame:
    """Adds the 15 statistics of a non-empty array.

    A standard deviation up to 1e-12 counts as none (skew and kurtosis 0), a mean of that
    size as 0 (cv 0).
    """
    df = df.withColumn("__x", doubles(x)).withColumn("__s", F.array_sort("__x"))
    df = df.withColumn("__m", total(F.col("__x")) / F.size("__x")).withColumn("__v", centred_power(F.col("__x"), F.col("__m"), 2))
    df = df.withColumn("__d", F.sqrt("__v"))
    a, s, m, d = F.col("__x"), F.col("__s"), F.col("__m"), F.col("__d")
    flat, n = d <= 1e-12, F.size(a)
    values = {
        "count": n.cast("double"), "mean": m, "var": F.col("__v"), "std": d, "min": F.get(s, F.lit(0)), "max": F.get(s, n - 1),
        "q25": quantile(s, 0.25), "median": quantile(s, 0.5), "q75": quantile(s, 0.75),
        "zero_ratio": share(a, lambda v: v == 0), "negative_ratio": share(a, lambda v: v < 0), "unique_ratio": F.size(F.array_distinct(a)) / n,
        "cv": F.when(F.abs(m) > 1e-12, F.try_divide(d, F.abs(m))).otherwise(0.0),
        "skew": F.when(flat, 0.0).otherwise(F.try_divide(centred_power(a, m, 3), d * d * d)),
        "kurtosis": F.when(flat, 0.0).otherwise(F.try_divide(centred_power(a, m, 4), d * d * d * d) - 3),
    }
    return df.withColumns({f"{prefix}_{k}": v for k, v in values.items()}).drop("__x", "__s", "__m", "__v", "__d")


def with_seven(df: DataFrame, prefix: str, x: Column) -> DataFrame:
    """Adds the seven-number summary; of an empty array all 0."""
    df = df.withColumn("__s", F.array_sort(doubles(x))).withColumn("__m", F.try_divide(total(F.col("__s")), F.size("__s")))
    s, m = F.col("__s"), F.col("__m")
    values = {f"q{round(100 * q):02d}": quantile(s, q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)}
    values |= {"mean": m, "std": F.sqrt(centred_power(s, m, 2))}
    some = F.size(s) > 0
    return df.withColumns({f"{prefix}_{k}": F.when(some, v).otherwise(0.0) for k, v in values.items()}).drop("__s", "__m")


def gini(x: Column) -> Column:
    """Gini coefficient by ranks; 0 if the sum is."""
    s = F.array_sort(doubles(x))
    ranked = F.aggregate(F.transform(s, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    n, t = F.size(s), total(s)
    return F.when(t > 0, 2 * F.try_divide(ranked, n * t) - (n + 1) / n).otherwise(0.0)


def midranks(x: Column) -> Column:
    """Mean zero-based rank of each element among all, ties shared."""
    return F.transform(x, lambda v: F.size(F.filter(x, lambda u: u < v)) + (F.size(F.filter(x, lambda u: u == v)) - 1) / 2)


def pearson(x: Column, y: Column) -> Column:
    """Correlation; 0 if either is constant."""
    n = F.size(x)
    mx, my = total(x) / n, total(y) / n
    cross = F.aggregate(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)), F.lit(0.0), lambda a, v: a + v)
    norms = F.sqrt(centred_power(x, mx, 2) * n) * F.sqrt(centred_power(y, my, 2) * n)
    constant = (F.array_min(x) == F.array_max(x)) | (F.array_min(y) == F.array_max(y))
    return F.when(constant, 0.0).otherwise(F.try_divide(cross, norms))


def sig7(x: Column) -> Column:
    """Seven significant digits, and 0 below 1e-9: for comparing engines that sum in different orders.

    The factor keeps values off the middle between two results, where engines round differently.
    """
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.abs(x) < 1e-9, 0.0).otherwise(F.format_string("%.6e", F.coalesce(x, F.lit(0.0)) * TIE_BREAK).cast("double"))


def gcd(x: Column) -> Column:
    """Greatest common divisor of an array of longs.

    Euclid's steps (64-bit numbers need fewer than 93) run only where a value is no
    multiple of the divisor so far.
    """

    def step(s: Column, _: Column) -> Column:
        rest = s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), rest.alias("b")))

    def both(a: Column, b: Column) -> Column:
        euclid = F.aggregate(F.sequence(F.lit(1), F.lit(93)), F.struct(a.alias("a"), b.alias("b")), step)["a"]
        return F.when(a == 0, b).when(b % F.when(a == 0, F.lit(1)).otherwise(a) == 0, a).otherwise(euclid)

    return F.aggregate(F.array_sort(F.array_distinct(x)), F.lit(0).cast("long"), lambda a, v: both(a, F.abs(v)))
