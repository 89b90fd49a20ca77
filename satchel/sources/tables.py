"""Typed readers and writers, and instances derived from relational tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INSTANCE = """instance_id string, origin string, variant string,
  parameters struct<weights: array<bigint>, profit: array<bigint>, profits: array<bigint>, capacity: bigint>,
  lineage struct<base_id: string, source: string, canonical_hash: string, proportional_hash: string, parent_instance_id: string, operator: string, operator_parameters: map<string, string>, round: int, seed: bigint>"""
#: Columns of the text corpus by place; the others are not used.
CORPUS_COLUMNS = {0: "base_id", 2: "question", 5: "source", 7: "problem"}
#: Sources kept by name, and origins with the label they get.
SOURCES = ("OptMATH", "IndOR")
ORIGINS = {"sage": "sage_original", "sage_original": "sage_original", "synthetic": "synthetic"}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(base_id, question, source, problem) of the knapsack rows of a CSV with a header, in columns by place.

    Rows with fewer than eight fields are left out; unknown sources become ``other``.
    """
    names = [CORPUS_COLUMNS.get(i, f"_{i}") for i in range(8)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True, encoding="UTF-8")
    rows = rows.where(F.col("problem") == "KP").select(*CORPUS_COLUMNS.values())
    return rows.withColumn("source", F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("other"))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Extracted or generated instances as JSON lines; blank lines are skipped."""
    rows = spark.read.schema(INSTANCE).json(path)
    p = F.col("parameters")
    return rows.select("instance_id", "origin", "variant", p["weights"].alias("weights"), F.coalesce(p["profit"], p["profits"]).alias("profit"), p["capacity"].alias("capacity"), "lineage")


def read_indexed(spark: SparkSession, path: str, columns: list[str], index: str = "instance_id") -> DataFrame:
    """A CSV table with a string id first and double columns; ids must be unique and not null."""
    rows = spark.read.schema(", ".join([f"{index} string", *(f"`{c}` double" for c in columns)])).csv(path, header=True, enforceSchema=False)
    return unique(rows, index)


def read_features(spark: SparkSession, path: str, declared: list[str]) -> DataFrame:
    """A CSV table of features, the id first; a column that is not declared raises."""
    header = spark.read.csv(path, header=True).columns
    if unknown := sorted({*header[1:]} - {*declared}):
        raise ValueError(f"undeclared feature columns: {unknown}")
    return read_indexed(spark, path, header[1:], header[0]).withColumnRenamed(header[0], "instance_id")


def read_origins(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """(instance_id, origin) that labels each row of ``table`` exactly once with a known origin; anything else raises."""
    rows = unique(spark.read.csv(path, header=True).select("instance_id", "origin"), "instance_id")
    require_same_ids(table, rows, "instance_id")
    known = F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False))
    return rows.withColumn("origin", F.when(known, F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("unknown origin of "), "instance_id")).cast("string")))


def unique(rows: DataFrame, index: str) -> DataFrame:
    """The rows themselves, checked as they are read: a null or repeated id raises."""
    n = F.count(F.lit(1)).over(Window.partitionBy(index))
    return rows.withColumn("__n", n).where(F.when(F.col(index).isNull() | (F.col("__n") > 1), F.raise_error(F.concat(F.lit("null or repeated id: "), F.coalesce(index, F.lit("null")))).cast("boolean")).otherwise(True)).drop("__n")


def require_same_ids(left: DataFrame, right: DataFrame, index: str) -> None:
    """Raises if an id is in one of the tables only; each side is checked by an anti join."""
    for a, b in ((left, right), (right, left)):
        if missing := a.join(b, index, "left_anti").select(index).head(5):
            raise ValueError(f"ids without a match: {[r[0] for r in missing]}")


def align(features: DataFrame, *others: DataFrame, index: str = "instance_id") -> DataFrame:
    """1:1 joins of tables over exactly the same ids."""
    for other in others:
        require_same_ids(features, other, index)
        features = features.join(other, index)
    return features


def origin_label(origin: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in ORIGINS.items():
        out = F.when(origin == name, F.lit(label)).otherwise(out)
    return out


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """One sha256 for the files of a folder, by their names and contents."""
    files = fingerprint(spark, path).select(F.concat_ws(" ", F.element_at(F.split("path", "/"), -1), "sha256").alias("line"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).head()[0]  # a line per file


def write_json(spark: SparkSession, value: dict, path: str, mode: str = "errorifexists") -> None:
    """A JSON document as a text folder; a number that is not finite raises."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def write_instances(rows: DataFrame, path: str, order: str) -> None:
    """JSON lines in the given order; the folder must not exist."""
    rows.orderBy(order).drop(order).write.mode("errorifexists").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header; doubles in their shortest exact form. The folder must not exist."""
    rows.write.mode("errorifexists").csv(path, header=True)


def kp_instances(lineitem: DataFrame, binding: bool = True) -> DataFrame:
    """Knapsack instances from orders: (instance_id, ord, weights, profit, capacity).

    An order's lines, 2 to 200, are the items: weight the quantity, profit the price
    rounded down; the capacity is a tenth to nine tenths of the weights, or all of them
    if not ``binding``. Items are ordered by line, part, supplier and price.
    """
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("w"), F.floor("l_extendedprice").cast("long").alias("p"))
    rows = lineitem.groupBy(F.col("l_orderkey").alias("ord")).agg(F.sort_array(F.collect_list(item)).alias("items")).where(F.size("items").between(2, 200))
    rows = rows.select("ord", F.transform("items", lambda x: x["w"]).alias("weights"), F.transform("items", lambda x: x["p"]).alias("profit"))
    weight = F.aggregate("weights", F.lit(0).cast("long"), lambda a, v: a + v)
    capacity = F.greatest(F.lit(1), F.floor(weight * (1 + F.col("ord") % 9) / 10)) if binding else weight
    return rows.select(F.concat(F.lit("order_"), F.col("ord")).alias("instance_id"), "ord", "weights", "profit", capacity.cast("long").alias("capacity"))


def items(instances: DataFrame) -> DataFrame:
    """(instance_id, i, w, p): one row per item."""
    return instances.select("instance_id", F.posexplode(F.arrays_zip("weights", "profit")).alias("i", "x")).select("instance_id", "i", F.col("x.weights").alias("w"), F.col("x.profit").alias("p"))
