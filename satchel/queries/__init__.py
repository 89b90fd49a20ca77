"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from satchel.queries import clouds, families, graphs, knapsack, sets

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return knapsack.QUERIES | families.QUERIES | clouds.QUERIES | graphs.QUERIES | sets.QUERIES


def oracle_sql() -> dict[str, str]:
    return knapsack.ORACLE | families.ORACLE | clouds.ORACLE | graphs.ORACLE | sets.ORACLE
