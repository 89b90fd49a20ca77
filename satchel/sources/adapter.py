"""Instances as JSON lines in either of two layouts, with a reason beside every row that is refused.

The extractor's layout has ``parameters`` and ``lineage``; the adapter's has ``instance``
and stored hashes. Both are read in one pass. Rows are never dropped silently: an audit
keeps the line itself, and strict reading raises once, with a count for each reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions.tasks import stored
from satchel.operators import hashing
from satchel.sources.tables import ORIGINS

_ITEMS = "weights array<decimal(38,6)>, profit array<decimal(38,6)>, profits array<decimal(38,6)>, capacity decimal(38,6)"
#: All fields of both layouts. Numbers with decimals lose them, as whole numbers are wanted.
RECORD = f"""problem string, instance_id string, question_id string, question string, origin string, variant string, generator string, validation string, parameters struct<{_ITEMS}>,
  canonical_hash string, proportional_hash string, source_kind string, generation_depth int, parent_canonical_hash string, instance struct<n_items: int, {_ITEMS}>,
  base_id string, parent_base_id string, operator string, operator_parameters string, round int, seed bigint,
  lineage struct<base_id: string, source: string, canonical_hash: string, proportional_hash: string>, __broken string"""
#: Lineage kept of an adapter's row.
LINEAGE = ("base_id", "parent_base_id", "parent_canonical_hash", "operator", "operator_parameters", "round", "seed")
VARIANT = "domain"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(line, record, r): every line that is not blank, numbered in reading order, and its fields. Stored, so numbers stay."""
    text = spark.read.text(path).withColumnRenamed("value", "record").withColumn("record", F.regexp_replace("record", "^﻿", ""))
    text = text.where(F.trim(F.col("record"), F.lit(" \t\r")) != "").withColumn("line", F.monotonically_increasing_id())
    return stored(text.withColumn("r", F.from_json("record", RECORD, {"columnNameOfCorruptRecord": "__broken"})), "records")


def _whole(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("bigint"))


def _named(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold; a test that is null does not."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(k)) for k, bad in tests.items())), lambda x: x.isNotNull())


def _repeated(rows: DataFrame, hashed: str) -> DataFrame:
    """Adds whether an earlier line has the same hash; first lines are found by a grouping that combines before the shuffle."""
    first = rows.where(F.col(hashed).isNotNull()).groupBy(hashed).agg(F.min("line").alias("__first"))
    return rows.join(first, hashed, "left").withColumn(f"repeated_{hashed}", F.coalesce(F.col("line") > F.col("__first"), F.lit(False))).drop("__first")


def audited(spark: SparkSession, path: str) -> DataFrame:
    """Every line in the adapter's form: canonical columns, ``lineage``, ``record`` (the line itself) and ``reasons``, empty for sound rows.

    Stored hashes must be those of the items. Of rows with the same hash the first line
    is sound. A row that is its own root has its hash as root, a derived one its parent's.
    """
    r, lines = F.col("r"), read_records(spark, path)
    adapted = r["instance"].isNotNull() & r["canonical_hash"].isNotNull()
    both = lambda name: F.when(adapted, r["instance"][name]).otherwise(r["parameters"][name])
    rows = lines.select(
        "line", "record", "r", F.coalesce(adapted, F.lit(False)).alias("adapted"), _whole(both("weights")).alias("weights"),
        _whole(F.coalesce(both("profit"), both("profits"))).alias("profit"), both("capacity").cast("bigint").alias("capacity"),
    )
    depth, kind = F.coalesce(r["generation_depth"], F.lit(0)), r["source_kind"]
    size = r["instance"]["n_items"]
    here = F.col("adapted")
    shape = hashing.reasons(F.col("weights"), F.col("profit"), F.col("capacity"), None)
    tests = _named({
        "not_json": r["__broken"].isNotNull() | r.isNull(), "not_a_kp_record": here & (r["problem"] != "KP"), "missing_proportional_hash": here & r["proportional_hash"].isNull(), "missing_source_kind": here & kind.isNull(),
        "generation_depth": here & ~depth.isin(0, 1), "source_kind_of_an_original": here & (depth == 0) & (kind != "sage_original"), "source_kind_of_a_derived": here & (depth == 1) & (kind != "sage_derived"),
        "n_items": here & F.coalesce((size != F.size("weights")) | ~size.between(*hashing.ITEMS), F.lit(True)), "no_root_parent_hash": here & (depth == 1) & (F.coalesce(r["parent_canonical_hash"], F.lit("")) == ""),
    })
    rows = rows.withColumn("reasons", F.concat(tests, F.when(r["__broken"].isNull(), shape).otherwise(F.array().cast("array<string>"))))
    whole = hashing.reasons(F.col("weights"), F.col("profit"), F.col("capacity"), None)
    hashed = hashing.with_proportional_hash(rows.where(F.size(whole) == 0).withColumn("canonical_hash", hashing.canonical_hash()))
    rows = rows.join(hashed.select("line", "canonical_hash", "proportional_hash"), "line", "left")
    for name in ("canonical_hash", "proportional_hash"):
        said = F.when(here, r[name]).otherwise(r["lineage"][name])
        rows = rows.withColumn("reasons", F.concat("reasons", _named({f"invalid_{name}": said.isNotNull() & (said != F.col(name))})))
    rows = stored(rows, "audited")
    # A refused row does not take a hash: strict reading would have stopped at it.
    free = F.size("reasons") == 0
    for name in ("canonical_hash", "proportional_hash"):
        sound = rows.where(free)
        rows = rows.where(~free).withColumn(f"repeated_{name}", F.lit(False)).unionByName(_repeated(sound, name))
    rows = rows.withColumn("reasons", F.concat("reasons", _named({"repeated_canonical_hash": F.col("repeated_canonical_hash"), "repeated_proportional_hash": F.col("repeated_proportional_hash")})))
    origin = F.coalesce(r["origin"], F.lit("sage_original"))
    source = F.when(here, kind).otherwise(hashing.source_kind(origin))
    root = F.when(here & (depth == 1), r["parent_canonical_hash"]).otherwise(F.col("canonical_hash"))
    lineage = F.when(here, F.struct(*(r[c].cast("string").alias(c) for c in LINEAGE), F.lit(None).cast("string").alias("source"), root.alias("root_parent_hash"))).otherwise(
        F.struct(*((F.coalesce(r["lineage"]["base_id"], F.lit("")) if c == "base_id" else F.lit(None).cast("string")).alias(c) for c in LINEAGE), F.coalesce(r["lineage"]["source"], F.lit("")).alias("source"), root.alias("root_parent_hash"))
    )
    return rows.select(
        "line", F.coalesce(r["instance_id"], F.concat(F.lit("sage_original_KP_"), F.left("canonical_hash", F.lit(10)))).alias("instance_id"), "canonical_hash", "proportional_hash", source.alias("source_kind"),
        F.when(here, depth).otherwise(F.when(source == "sage_original", 0).otherwise(1)).alias("generation_depth"), root.alias("root_parent_hash"), hashing.split_group(root).alias("split_group_id"),
        F.size("weights").alias("n_items"), "weights", "profit", "capacity", lineage.alias("lineage"), "record", "reasons",
    )


def refused(rows: DataFrame) -> dict[str, int]:
    """How many rows have each reason."""
    return {r.reason: r["count"] for r in rows.select(F.explode("reasons").alias("reason")).groupBy("reason").count().orderBy("reason").collect()}


def read_adapted(spark: SparkSession, path: str) -> DataFrame:
    """The sound rows of ``audited``; a file with other rows, or with none, raises, with the count of each reason."""
    rows = stored(audited(spark, path), "adapted")
    if counts := refused(rows):
        raise ValueError(f"rows are refused: {counts}")
    if not rows.head(1):
        raise ValueError("KP instance file is empty")
    return rows.drop("record", "reasons")


def audit_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instances to be featurized: instance_id, origin, items, ``question``, ``record`` and ``reasons``.

    The id is instance_id, else question_id; ids must be there and unique, or reading
    raises. A synthetic instance says its generator, seed and validation.
    """
    r = F.col("r")
    p = r["parameters"]
    rows = read_records(spark, path).select(
        F.coalesce(r["instance_id"], r["question_id"]).alias("instance_id"), r["origin"].alias("origin"), r["question"].alias("question"), _whole(p["weights"]).alias("weights"),
        _whole(F.coalesce(p["profit"], p["profits"])).alias("profit"), p["capacity"].cast("bigint").alias("capacity"), "record", "r",
    )
    named = rows.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.coalesce("instance_id", F.lit("")) == ""))
    if found := named.head(3):
        raise ValueError(f"every instance needs an id of its own: {[x.instance_id for x in found]}")
    tests = _named({
        "not_json": r["__broken"].isNotNull(), "origin": ~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False)),
        "provenance": (F.col("origin") == "synthetic") & (r["generator"].isNull() | r["seed"].isNull() | r["validation"].isNull()), "variant": F.coalesce(r["variant"], F.lit(VARIANT)) != VARIANT,
    })
    return rows.withColumn("reasons", F.concat(hashing.reasons(F.col("weights"), F.col("profit"), F.col("capacity")), tests)).drop("r")
