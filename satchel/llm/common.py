"""Shared helpers: scratch tables in the cluster's shared folder, and text rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What every operator here calls a word: a run free of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that is unset: a temporary folder for a local master (driver and
    executors are then one process), else the warehouse, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        found = tempfile.mkdtemp(prefix="satchel-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    It cuts the lineage with data that outlives executors and fixes the values of
    non-deterministic columns (row ids) for everything downstream.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for helper columns beside it."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
