"""Features of quadratic knapsacks: items, and profits of pairs of them, as expressions of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.arrays import centred_power, doubles, gini, pearson, share, total
from satchel.operators.compatibility import triples
from satchel.operators.features import pairs

TINY = 1e-12


def _mean(x: Column) -> Column:
    return F.coalesce(F.try_divide(total(x), F.size(x)), F.lit(0.0))


def _deviation(x: Column, mean: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(centred_power(x, mean, 2))).otherwise(0.0)


def quadratic_features(instances: DataFrame) -> DataFrame:
    """The 27 features, a row per instance with items; nothing is shuffled.

    ``instances``: instance_id, weights, profit, capacity and pair_profit, an array of
    (i, j, v) with v the profit of items i < j together. Pairs in other order, or without
    a profit above 0, count as having none.
    """
    sound = instances.where(F.size("weights") > 0)
    df = sound.select("instance_id", doubles(F.col("weights")).alias("w"), doubles(F.col("profit")).alias("p"), F.col("capacity").cast("double").alias("c"), F.filter("pair_profit", lambda x: (x["i"] < x["j"]) & (x["v"] > 0)).alias("q"))
    df = df.withColumns({"v": F.transform("q", lambda x: x["v"].cast("double")), "joint": F.transform("q", lambda x: F.get("w", x["i"]) + F.get("w", x["j"])), "n": F.size("w")})
    df = df.withColumns({"wm": _mean(F.col("w")), "pm": _mean(F.col("p")), "vm": _mean(F.col("v")), "whole": F.greatest(total(F.col("w")), F.lit(1.0)), "linear": total(F.col("p")), "paired": total(F.col("v"))})
    df = df.withColumns({"wd": _deviation(F.col("w"), F.col("wm")), "pd": _deviation(F.col("p"), F.col("pm")), "vd": _deviation(F.col("v"), F.col("vm"))})
    df = df.withColumn("high", F.transform(F.filter("q", lambda x: x["v"] >= F.col("vm") + F.col("vd")), lambda x: F.struct(x["i"].cast("int").alias("i"), x["j"].cast("int").alias("j"))))
    # a-b and b-c and a-c all high
    closed = F.aggregate("high", F.lit(0), lambda n, x: n + F.size(F.filter("high", lambda y: (y["i"] == x["j"]) & F.exists("high", lambda z: (z["i"] == x["i"]) & (z["j"] == y["j"])))))
    df = df.withColumns({"closed": closed, "s2": pairs(F.col("w"), lambda a, b: a + b), "s3": triples(F.col("w"), lambda a, b, c: a + b + c)})
    w, p, v, c, n = (F.col(x) for x in ("w", "p", "v", "c", "n"))
    count, three, gain = F.greatest(F.size("s2"), F.lit(1)), F.greatest(F.size("s3"), F.lit(1)), F.greatest(F.col("linear") + F.col("paired"), F.lit(1.0))
    ratio = lambda d, m: F.when(F.abs(m) > TINY, F.try_divide(F.col(d), F.col(m))).otherwise(0.0)
    over = lambda x: F.size(F.filter(x, lambda s: s > c))
    skew = F.when((F.size(v) >= 3) & (F.col("vd") > TINY), F.try_divide(centred_power(v, F.col("vm"), 3), F.col("vd") * F.col("vd") * F.col("vd"))).otherwise(0.0)
    values = {
        "n": n, "capacity_ratio": c / F.col("whole"), "capacity_max_weight_ratio": c / F.greatest(F.array_max(w), F.lit(1.0)), "mean_weight_capacity_ratio": F.col("wm") / F.greatest(c, F.lit(1.0)), "max_weight_capacity_ratio": F.array_max(w) / F.greatest(c, F.lit(1.0)),
        "weight_std": F.col("wd"), "weight_cv": ratio("wd", "wm"), "weight_gini": gini(w), "large_weight_ratio": share(w, lambda x: x > 0.5 * c), "medium_large_weight_ratio": share(w, lambda x: (x > 0.25 * c) & (x <= 0.5 * c)), "small_weight_ratio": share(w, lambda x: x <= 0.1 * c),
        "linear_profit_mean": F.col("pm"), "linear_profit_cv": ratio("pd", "pm"), "profit_weight_corr": pearson(p, w), "pair_density": F.size(v) / count, "pair_profit_mean": F.col("vm"), "pair_profit_cv": ratio("vd", "vm"), "pair_profit_skew": skew,
        "pair_profit_gini": F.when(F.size(v) > 0, gini(v)).otherwise(0.0), "linear_profit_share": F.col("linear") / gain, "quadratic_profit_share": F.col("paired") / gain, "pair_profit_weight_corr": F.when(F.size(v) > 1, pearson(v, F.col("joint"))).otherwise(0.0),
        "high_pair_profit_ratio": F.size("high") / F.greatest(F.size(v), F.lit(1)), "zero_pair_profit_ratio": 1 - F.size(v) / count, "high_pair_triangle_ratio": F.col("closed") / three, "pair_over_capacity_ratio": over("s2") / count, "triplet_over_capacity_ratio": over("s3") / three,
    }
    return df.select("instance_id", *(x.cast("double").alias(k) for k, x in values.items()))
