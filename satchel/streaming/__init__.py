"""Streaming ingest: drop instances whose exact hash was seen, with a bounded watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from satchel.operators.hashing import with_hashes


def ingest(instances: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """A stream of instances (instance_id, weights, profit, capacity, event time) without repeats within ``delay``."""
    return with_hashes(instances).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["canonical_hash"])
