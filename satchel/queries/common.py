"""Pieces of SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satchel.functions.arrays import TIE_BREAK
from satchel.functions.batches import rounded  # noqa: F401
from satchel.sources.tables import kp_instances

#: Instances: a row per order with 2 to 200 lines, its lists in item order.
INSTANCES = """
  item AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i,
                  CAST(l_quantity AS BIGINT) AS w, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem),
  kp AS (SELECT 'order_' || l_orderkey AS instance_id, l_orderkey AS ord, list(w ORDER BY i) AS weights, list(p ORDER BY i) AS profit,
                CAST(greatest(1, sum(w) * (1 + l_orderkey % 9) // 10) AS BIGINT) AS capacity, count(*) AS n
         FROM item GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 200),
  it AS (SELECT kp.instance_id, kp.ord, item.i, item.w, item.p, kp.capacity AS c, kp.n FROM kp JOIN item ON kp.ord = item.l_orderkey)"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kp_instances(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def sig(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-9 THEN 0.0 ELSE CAST(format('{{:.6e}}', CAST({x} AS DOUBLE) * CAST({TIE_BREAK} AS DOUBLE)) AS DOUBLE) END"


def stats_sql(name: str, x: str) -> list[str]:
    """The 15 statistics of x over a group in which m and d, its mean and deviation, were joined as {name}_m, {name}_d."""
    m, d = f"any_value({name}_m)", f"any_value({name}_d)"
    values = {
        "count": "CAST(count(*) AS DOUBLE)", "mean": m, "var": f"{d} * {d}", "std": d, "min": f"min({x})", "max": f"max({x})",
        "q25": f"quantile_cont({x}, 0.25)", "median": f"quantile_cont({x}, 0.5)", "q75": f"quantile_cont({x}, 0.75)",
        "zero_ratio": f"avg(CAST({x} = 0 AS INT))", "negative_ratio": f"avg(CAST({x} < 0 AS INT))", "unique_ratio": f"count(DISTINCT {x}) / count(*)",
        "cv": f"CASE WHEN abs({m}) > 1e-12 THEN {d} / abs({m}) ELSE 0 END",
        "skew": f"CASE WHEN {d} <= 1e-12 THEN 0 ELSE avg(pow({x} - {name}_m, 3)) / pow({d}, 3) END",
        "kurtosis": f"CASE WHEN {d} <= 1e-12 THEN 0 ELSE avg(pow({x} - {name}_m, 4)) / pow({d}, 4) - 3 END",
    }
    return [f"{sig(v)} AS {name}_{k}" for k, v in values.items()]


def seven_sql(name: str, x: str) -> list[str]:
    quantiles = [f"{sig(f'quantile_cont({x}, {q})')} AS {name}_q{round(100 * q):02d}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return [*quantiles, f"{sig(f'avg({x})')} AS {name}_mean", f"{sig(f'stddev_pop({x})')} AS {name}_std"]
