"""How rows are dealt to tasks, and tables kept between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the session's shuffle partitions.

    For rows that are small but cost much time each: adaptive execution sizes partitions
    by bytes and would put them all into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset: a temporary folder for a local master, whose driver and executors
    are one process, else a folder in the warehouse, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] == "local":
        found = tempfile.mkdtemp(prefix="satchel-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
