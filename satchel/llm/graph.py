"""Connected components by label propagation with pointer jumping.

Each round a node takes the smallest label among its own and its neighbours', then its
label's label, so paths shrink geometrically. Labels and edges are stored tables, minima
are combined before the shuffle and the joins are plain equi-joins whose large side Spark
may split, so a node with very many neighbours is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import materialise


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (src, dst); the smallest node names the component."""
    both = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("component")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("component").alias("heard"))
        nearer = materialise(labels.join(heard, F.col("node") == F.col("to")).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component")), "labels")
        jumped = nearer.select(F.col("node").alias("via"), F.col("component").alias("far"))
        labels = materialise(nearer.join(jumped, F.col("component") == F.col("via")).select("node", "old", F.col("far").alias("component")), "labels")
        if not labels.where("old <> component").head(1):
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
