"""Features of packing instances: relative sizes, their classes, and what the last bin leaves free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.arrays import share, total, with_stats

#: Classes of relative sizes, above the first and up to the second bound.
CLASSES = {"huge": (0.5, None), "large": (1 / 3, 0.5), "medium": (0.25, 1 / 3), "small": (0.1, 0.25), "tiny": (None, 0.1)}


def packing_features(instances: DataFrame) -> DataFrame:
    """The 24 features, a row per instance whose items are larger than nothing and fit a bin; nothing is shuffled."""
    sound = instances.where((F.size("sizes") > 0) & (F.col("capacity") > 0)).where(F.forall("sizes", lambda s: F.coalesce((s > 0) & (s <= F.col("capacity")), F.lit(False))))
    df = sound.select("instance_id", F.col("capacity").cast("double").alias("c"), F.transform("sizes", lambda s: s / F.col("capacity").cast("double")).alias("r"))
    df = with_stats(df, "relative_size", F.col("r")).withColumn("t", total(F.col("r")))

    def among(low: float | None, high: float | None):
        inside = [lambda v, b=low: v > b] * (low is not None) + [lambda v, b=high: v <= b] * (high is not None)
        return share(F.col("r"), lambda v: inside[0](v) if len(inside) == 1 else inside[0](v) & inside[1](v))

    more = {"item_count": F.size("r").cast("double"), "bin_capacity": F.col("c"), "total_size_ratio": F.col("t"), "remaining_capacity_fraction": F.ceil("t") - F.col("t")} | {f"{k}_item_ratio": among(*b) for k, b in CLASSES.items()}
    names = [c for c in df.columns if c.startswith("relative_size_")]
    return df.select("instance_id", *names, *(v.cast("double").alias(k) for k, v in more.items()))
