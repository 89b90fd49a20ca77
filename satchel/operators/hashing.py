"""Canonical hashes, dedupe, normalization, validation and split groups of instances."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: What the adapter calls each origin.
SOURCE_KINDS = {"sage": "sage_original", "sage_original": "sage_original", "synthetic": "sage_derived"}
#: Least and most items of an instance.
ITEMS = (2, 200)


def digits(value: float) -> str:
    return format(float(value), ".15g")


def scaled(values: list) -> list[float]:
    """Divided by the smallest absolute value that is not 0."""
    unit = min((abs(float(v)) for v in values if v), default=1.0)
    return [float(v) / unit for v in values]


def payload(weights: list, profit: list, capacity: float, proportional: bool, generated: bool) -> str:
    """What is hashed. The generator's payload has other fields than the extractor's and adapter's."""
    values = [*weights, *profit, capacity]
    texts = [digits(v) for v in (scaled(values) if proportional else values)]
    fields = {"problem": "KP", "proportional": proportional}
    fields |= {"values": texts} if generated else {"n_items": len(weights), "weights_profits_capacity": texts}
    return json.dumps(fields, sort_keys=True, separators=(",", ":"))


def instance_hash(weights: list, profit: list, capacity: float, proportional: bool = False, generated: bool = False) -> str:
    return hashlib.sha256(payload(weights, profit, capacity, proportional, generated).encode()).hexdigest()


def all_values() -> Column:
    return F.concat(F.col("weights"), F.col("profit"), F.array("capacity"))


def canonical_hash(generated: bool = False) -> Column:
    """The exact hash of integer instances; below 1e15 an integer's 15 digits are its text."""
    texts = F.concat(F.lit('["'), F.array_join(all_values().cast("array<string>"), '","'), F.lit('"]'))
    if generated:
        return F.sha2(F.concat(F.lit('{"problem":"KP","proportional":false,"values":'), texts, F.lit("}")), 256)
    head = F.concat(F.lit('{"n_items":'), F.size("weights").cast("string"), F.lit(',"problem":"KP","proportional":false,"weights_profits_capacity":'))
    return F.sha2(F.concat(head, texts, F.lit("}")), 256)


@F.arrow_udf(ArrayType(LongType()))
def _reduced(values: pa.Array) -> pa.Array:
    """Each list by the greatest common divisor of its numbers, which are not empty; a list with a null stays."""
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    filled, flat = lengths > 0, values.flatten()
    if not filled.any():
        return values
    numbers, holes = pc.fill_null(flat, 1).to_numpy(zero_copy_only=False), pc.is_null(flat).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    unit = np.repeat(np.maximum(np.gcd.reduceat(numbers, starts[filled]), 1), lengths[filled])
    ends = pa.array(np.r_[starts, len(flat)].astype(np.int32), mask=np.r_[~pc.is_valid(values).to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(ends, pa.array(numbers // unit, mask=holes))


def proportional_key() -> Column:
    """Equal for instances that differ by a factor only: the values by their greatest common divisor."""
    return F.sha2(F.array_join(_reduced(all_values().cast("array<bigint>")).cast("array<string>"), ","), 256)


@F.pandas_udf(StringType())
def _proportional(weights: pd.Series, profit: pd.Series, capacity: pd.Series) -> pd.Series:
    return pd.Series([instance_hash([*w], [*p], c, True) for w, p, c in zip(weights, profit, capacity, strict=True)])


def with_hashes(instances: DataFrame) -> DataFrame:
    """Adds canonical_hash and proportional_key; only divisors are found in Python, a batch at a time."""
    return instances.withColumns({"canonical_hash": canonical_hash(), "proportional_key": proportional_key()})


def with_proportional_hash(instances: DataFrame) -> DataFrame:
    """Adds proportional_hash, whose C-style digits need Python."""
    return instances.withColumn("proportional_hash", _proportional("weights", "profit", "capacity"))


def dedupe(instances: DataFrame, order: str = "ord", parents: DataFrame | None = None) -> DataFrame:
    """The first row of each class of proportional instances, and none whose class is among ``parents``.

    Equal instances are proportional, so one key is enough. Of a class only the smallest
    ``order`` is kept, by ranks of which all but the first go before the shuffle; rows
    without an order or with an empty key are left out.
    """
    keyed = with_hashes(instances).where(F.col("proportional_key").isNotNull() & F.col(order).isNotNull())
    rank = F.rank().over(Window.partitionBy("proportional_key").orderBy(order))
    kept = keyed.withColumn("__rank", rank).where("__rank = 1").drop("__rank").select("proportional_key", order, *(c for c in keyed.columns if c not in ("proportional_key", order)))
    return kept if parents is None else kept.join(with_hashes(parents).select("proportional_key"), "proportional_key", "left_anti")


def numbered(instances: DataFrame, order: str = "ord", prefix: str = "sage_original_KP_", width: int = 4, position: str = "sequence") -> DataFrame:
    """Adds a consecutive number by ``order`` and the id made of it and the hash.

    Numbers are ranks inside range partitions plus the partitions' offsets, so the rows
    are never gathered in one task.
    """
    spark = instances.sparkSession
    # Cached, so that both uses see one partitioning; a lost part is dealt the same again.
    sliced = instances.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).persist()
    sizes = sorted(sliced.groupBy("__part").count().collect())  # a row per partition
    ends = [sum(n for _, n in sizes[:i]) for i in range(len(sizes))]
    table = spark.createDataFrame([(part, end) for (part, _), end in zip(sizes, ends, strict=True)] or [(0, 0)], "__part int, __offset long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    out = sliced.withColumn("__rank", rank).join(F.broadcast(table), "__part").withColumn(position, F.col("__rank") + F.col("__offset"))
    number = F.col(position).cast("string")
    number = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return out.withColumn("numbered_id", F.concat(F.lit(prefix), number, F.lit("_"), F.left("canonical_hash", F.lit(10)))).drop("__part", "__offset", "__rank")


def reasons(weights: Column, profit: Column, capacity: Column, upper: int | None = ITEMS[1]) -> Column:
    """What makes an instance invalid, empty if nothing does; ``upper`` None: any number of items."""
    n = F.size(weights)
    checks = [
        ("missing_field", weights.isNull() | profit.isNull() | capacity.isNull()),
        ("item_count", (n < ITEMS[0]) | (F.lit(False) if upper is None else n > upper)),
        ("length_mismatch", n != F.size(profit)),
        ("nonpositive_weight", F.exists(weights, lambda w: w.isNull() | (w <= 0))),
        ("negative_profit", F.exists(profit, lambda p: p.isNull() | (p < 0))),
        ("nonpositive_capacity", capacity <= 0),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks)), lambda x: x.isNotNull())


def validated(instances: DataFrame, mode: str = "audit", upper: int | None = ITEMS[1]) -> DataFrame:
    """``audit`` adds the reasons, ``drop`` leaves invalid rows out, ``fail`` raises on the first."""
    rows = instances.withColumn("reasons", reasons(F.col("weights"), F.col("profit"), F.col("capacity"), upper))
    if mode == "audit":
        return rows
    good = F.size("reasons") == 0
    if mode == "drop":
        return rows.where(good).drop("reasons")
    return rows.where(F.when(good, True).otherwise(F.raise_error(F.concat_ws(",", "reasons")).cast("boolean"))).drop("reasons")


def split_group(root_hash: Column) -> Column:
    return F.concat(F.lit("kp-root:"), F.left(F.sha2(root_hash, 256), F.lit(20)))


def source_kind(origin: Column) -> Column:
    out = origin
    for name, kind in SOURCE_KINDS.items():
        out = F.when(origin == name, F.lit(kind)).otherwise(out)
    return out


def normalized(instances: DataFrame, verify: bool = True) -> DataFrame:
    """The adapter's canonical form of extracted instances, hashes checked against stored ones.

    ``instances``: instance_id, origin, weights, profit, capacity and, if there,
    stored_hash; its parent is its own root.
    """
    rows = with_proportional_hash(instances.withColumn("canonical_hash", canonical_hash()))
    if verify and "stored_hash" in instances.columns:
        same = F.col("stored_hash").isNull() | (F.col("stored_hash") == F.col("canonical_hash"))
        rows = rows.where(F.when(same, True).otherwise(F.raise_error(F.lit("invalid canonical_hash")).cast("boolean")))
    kind = source_kind(F.col("origin"))
    return rows.select(
        F.lit("KP").alias("problem"), F.coalesce("instance_id", F.concat(F.lit("sage_original_KP_"), F.left("canonical_hash", F.lit(10)))).alias("instance_id"),
        "canonical_hash", "proportional_hash", kind.alias("source_kind"), F.when(kind == "sage_original", 0).otherwise(1).alias("generation_depth"),
        F.size("weights").alias("n_items"), "weights", "profit", "capacity", F.col("canonical_hash").alias("root_hash"), split_group(F.col("canonical_hash")).alias("split_group"),
    )
