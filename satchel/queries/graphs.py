"""Graphs of nations: the arcs of each order year as tours, those of each brand as path instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import graphs
from satchel.queries.common import rounded, sig

#: What an arc costs between nations that did not trade.
DEFAULT = 500


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traded(spark: SparkSession, sf_dir: str, graph: str) -> DataFrame:
    """(graph, i, j, cost): the mean price in hundreds of what customers in nation i ordered from suppliers in nation j."""
    line, orders, part = (_read(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    customer, supplier = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    if graph == "brand":
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    key = {"year": F.year("o_orderdate").cast("string"), "brand": F.col("p_brand") if graph == "brand" else None}[graph]
    found = rows.groupBy(key.alias("graph"), F.col("c_nationkey").cast("int").alias("i"), F.col("s_nationkey").cast("int").alias("j"))
    return found.agg(F.floor(F.sum(F.floor("l_extendedprice").cast("long")) / F.count(F.lit(1)) / 100).cast("double").alias("cost"))


def _tours(spark: SparkSession, sf_dir: str, symmetric: bool = False) -> DataFrame:
    arcs = graphs.completed(traded(spark, sf_dir, "year"), DEFAULT)
    if not symmetric:
        return arcs
    return arcs.join(graphs.swapped(arcs), ["graph", "i", "j"]).select("graph", "i", "j", F.greatest("cost", "back").alias("cost"))


def tour_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.directed_features(_tours(spark, sf_dir)))


def tour_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.symmetric_features(_tours(spark, sf_dir, True)))


def tour_spanning_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and edges of the least spanning tree of each year's graph; all graphs in one job."""
    tree = graphs.spanning_forest(_tours(spark, sf_dir, True))
    return tree.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.sum("cost").alias("weight"))


def path_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.path_features(traded(spark, sf_dir, "brand")))


QUERIES = {f.__name__: f for f in (tour_directed, tour_symmetric, tour_spanning_trees, path_graphs)}


def _traded_sql(name: str, graph: str) -> str:
    return f"""{name} AS (SELECT {graph} AS graph, c_nationkey AS i, s_nationkey AS j, CAST(floor(sum(CAST(floor(l_extendedprice) AS BIGINT)) / count(*) / 100) AS DOUBLE) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


_TOURS = f"""WITH RECURSIVE {_traded_sql('found', 'CAST(year(o_orderdate) AS VARCHAR)')},
  node AS (SELECT graph, i FROM found UNION SELECT graph, j FROM found),
  directed AS (SELECT x.graph, x.i, y.i AS j, coalesce(f.cost, {DEFAULT}) AS cost FROM node x JOIN node y ON x.graph = y.graph AND x.i <> y.i LEFT JOIN found f ON f.graph = x.graph AND f.i = x.i AND f.j = y.i),
  sym AS (SELECT a.graph, a.i, a.j, greatest(a.cost, b.cost) AS cost FROM directed a JOIN directed b ON a.graph = b.graph AND a.i = b.j AND a.j = b.i),
  size AS (SELECT graph, count(*) AS n FROM node GROUP BY 1)"""


def _cv(x: str) -> str:
    return f"CASE WHEN abs(avg({x})) > 1e-12 THEN stddev_pop({x}) / abs(avg({x})) ELSE 0 END"


def _peak(x: str) -> str:
    return f"CASE WHEN abs(avg({x})) > 1e-12 THEN max({x}) / abs(avg({x})) ELSE 0 END"


def _shape_sql(arcs: str) -> str:
    return f"""shape AS (SELECT graph, any_value(m) AS m, {_cv('cost')} AS cv, CASE WHEN any_value(d) <= 1e-12 THEN 0 ELSE avg(pow((cost - m) / d, 3)) END AS skew, CASE WHEN any_value(d) <= 1e-12 THEN 0 ELSE avg(pow((cost - m) / d, 4)) - 3 END AS kurtosis,
    (max(cost) - min(cost)) / any_value(m) AS range, avg(CAST(cost >= 1.5 * m AS INT)) AS long, avg(CAST(cost <= 0.5 * m AS INT)) AS short, 1 - count(DISTINCT cost) / count(*) AS tie
    FROM (SELECT *, avg(cost) OVER g AS m, stddev_pop(cost) OVER g AS d FROM {arcs} WINDOW g AS (PARTITION BY graph)) GROUP BY graph)"""


def _near_sql(name: str, arcs: str, node: str) -> str:
    return f"""{name}_node AS (SELECT graph, {node} AS i, avg(cost) AS mean, list_sort(list(cost)) AS c FROM {arcs} GROUP BY 1, 2),
  {name} AS (SELECT graph, avg(c[1]) AS first, {_cv('c[1]')} AS first_cv, avg(CASE WHEN abs(c[2]) > 1e-12 THEN c[1] / c[2] ELSE 1 END) AS ratio, {_cv('mean')} AS mean_cv, {_peak('mean')} AS peak FROM {name}_node GROUP BY 1)"""


def _select(values: dict[str, str]) -> str:
    return "SELECT shape.graph, " + ", ".join(f"CAST({sig(v)} AS DOUBLE) AS {k}" for k, v in values.items())


#: A node at a time, the cheapest arc from the tree to a node outside it.
_PRIM = """grown(graph, inside, cost) AS (SELECT graph, [min(i)], CAST(NULL AS DOUBLE) FROM sym GROUP BY 1 UNION ALL
    SELECT graph, list_append(inside, j), cost FROM (SELECT g.graph, g.inside, a.j, a.cost, row_number() OVER (PARTITION BY g.graph ORDER BY a.cost, a.i, a.j) AS k
      FROM grown g JOIN sym a ON a.graph = g.graph AND list_contains(g.inside, a.i) AND NOT list_contains(g.inside, a.j)) WHERE k = 1)"""

_PATH_PARTS = {"outgoing_mean": "o", "incoming_mean": "p", "mean_cost_imbalance": "abs(o - p)", "outgoing_minimum_gap": "og", "incoming_minimum_gap": "pg"}


def _seven_sql(name: str, x: str) -> dict[str, str]:
    found = {f"sp_{name}_q{round(100 * q):02d}": f"quantile_cont({x}, {q})" for q in (0.0, 0.25, 0.5, 0.75, 1.0)}
    return {k: f"coalesce({v}, 0)" for k, v in (found | {f"sp_{name}_mean": f"avg({x})", f"sp_{name}_std": f"stddev_pop({x})"}).items()}


_BY_NODE = {k: v for name, x in _PATH_PARTS.items() for k, v in _seven_sql(name, x).items()} | {
    "sp_no_outgoing_arc_node_fraction": "avg(CAST(od = 0 AS INT))", "sp_no_incoming_arc_node_fraction": "avg(CAST(pd = 0 AS INT))", "sp_two_outgoing_arc_node_fraction": "avg(CAST(od >= 2 AS INT))", "sp_two_incoming_arc_node_fraction": "avg(CAST(pd >= 2 AS INT))",
}
_BY_PAIR = _seven_sql("reciprocal_cost_difference", "abs(a.r - b.r)")

ORACLE = {
    "tour_directed": f"""{_TOURS}, {_shape_sql('directed')}, {_near_sql('o', 'directed', 'i')}, {_near_sql('p', 'directed', 'j')},
        pair AS (SELECT a.graph, avg(abs(a.cost - b.cost)) AS gap, max(abs(a.cost - b.cost)) AS most, {_cv('abs(a.cost - b.cost)')} AS gap_cv, avg(CAST(a.cost = b.cost AS INT)) AS equal, corr(a.cost, b.cost) AS corr FROM directed a JOIN directed b ON a.graph = b.graph AND a.i = b.j AND a.j = b.i GROUP BY 1),
        apart AS (SELECT a.graph, avg(abs(a.mean - b.mean)) AS apart FROM o_node a JOIN p_node b ON a.graph = b.graph AND a.i = b.i GROUP BY 1)
        """ + _select({
            "n": "n", "directed_cost_mean": "m", "directed_cost_cv": "cv", "directed_cost_skew": "skew", "directed_cost_kurtosis": "kurtosis", "directed_cost_range_ratio": "range", "directed_long_edge_ratio": "long", "directed_short_edge_ratio": "short", "directed_tie_ratio": "tie",
            "out_nearest_mean_ratio": "o.first / m", "out_nearest_cv": "o.first_cv", "in_nearest_mean_ratio": "p.first / m", "in_nearest_cv": "p.first_cv", "out_first_second_ratio": "o.ratio", "in_first_second_ratio": "p.ratio", "outgoing_mean_cv": "o.mean_cv", "incoming_mean_cv": "p.mean_cv",
            "in_out_mean_gap_ratio": "apart / m", "outgoing_node_eccentricity": "o.peak", "incoming_node_eccentricity": "p.peak", "reciprocal_abs_gap_mean_ratio": "gap / m", "reciprocal_abs_gap_max_ratio": "most / m", "reciprocal_abs_gap_cv": "gap_cv", "reciprocal_cost_correlation": "corr", "reciprocal_equal_ratio": "equal",
        }) + " FROM shape JOIN size USING (graph) JOIN o USING (graph) JOIN p USING (graph) JOIN pair USING (graph) JOIN apart USING (graph)",
    "tour_symmetric": f"""{_TOURS}, edge AS (SELECT * FROM sym WHERE i < j), {_shape_sql('edge')}, {_near_sql('o', 'sym', 'i')}, {_PRIM},
        tree AS (SELECT graph, sum(cost) AS weight, {_cv('cost')} AS tree_cv FROM grown WHERE cost IS NOT NULL GROUP BY 1),
        triangle AS (SELECT a.graph, avg(CAST(c.cost > a.cost + b.cost AS INT)) AS violations, avg(c.cost - a.cost - b.cost) FILTER (c.cost > a.cost + b.cost) AS excess
          FROM sym a JOIN sym b ON a.graph = b.graph AND a.j = b.i JOIN sym c ON a.graph = c.graph AND a.i = c.i AND b.j = c.j GROUP BY 1),
        low AS (SELECT graph, quantile_cont(cost, 0.25) AS low FROM edge GROUP BY 1),
        cheap AS (SELECT graph, i, j FROM sym JOIN low USING (graph) WHERE cost <= low),
        density AS (SELECT graph, avg(CAST(cost <= low AS INT)) AS density FROM edge JOIN low USING (graph) GROUP BY 1),
        reach(graph, a, b) AS (SELECT graph, i, i FROM node UNION SELECT r.graph, r.a, c.j FROM reach r JOIN cheap c ON r.graph = c.graph AND r.b = c.i),
        part AS (SELECT graph, count(DISTINCT least) AS parts FROM (SELECT graph, a, min(b) AS least FROM reach GROUP BY 1, 2) GROUP BY 1),
        degree AS (SELECT graph, {_cv('k')} AS degree_cv FROM (SELECT node.graph, node.i, count(c.j) AS k FROM node LEFT JOIN cheap c ON node.graph = c.graph AND node.i = c.i GROUP BY 1, 2) GROUP BY 1),
        mutual AS (SELECT s.graph, avg(CAST(s.cost = q.c[1] AS INT)) AS mutual FROM sym s JOIN o_node p ON s.graph = p.graph AND s.i = p.i JOIN o_node q ON s.graph = q.graph AND s.j = q.i WHERE s.cost = p.c[1] GROUP BY 1)
        """ + _select({
            "n": "n", "edge_cost_mean": "m", "edge_cost_cv": "cv", "edge_cost_skew": "skew", "edge_cost_kurtosis": "kurtosis", "edge_cost_range_ratio": "range", "edge_long_ratio": "long", "edge_short_ratio": "short", "edge_tie_ratio": "tie",
            "nearest_mean_ratio": "o.first / m", "nearest_cv": "o.first_cv", "first_second_ratio": "o.ratio", "node_mean_cv": "o.mean_cv", "node_eccentricity": "o.peak", "triangle_violation_ratio": "violations", "triangle_violation_mean_ratio": "coalesce(excess, 0) / m",
            "mst_weight_ratio": "weight / ((n - 1) * m)", "mst_edge_cv": "tree_cv", "low_cost_graph_density": "density", "low_cost_component_ratio": "parts / n", "low_cost_degree_cv": "degree_cv", "nearest_reciprocity": "mutual",
        }) + " FROM shape " + " ".join(f"JOIN {t} USING (graph)" for t in ("size", "o", "tree", "triangle", "density", "part", "degree", "mutual")),
    "tour_spanning_trees": f"{_TOURS}, {_PRIM} SELECT graph, count(cost) AS edges, sum(cost) AS weight FROM grown GROUP BY 1",
    "path_graphs": f"""WITH {_traded_sql('found', 'p_brand')}, scale AS (SELECT graph, avg(abs(cost)) AS scale, count(*) AS arcs FROM found WHERE i <> j GROUP BY 1),
        arc AS (SELECT graph, i, j, CASE WHEN scale > 0 THEN cost / scale ELSE 0 END AS r FROM found JOIN scale USING (graph) WHERE i <> j),
        node AS (SELECT graph, i FROM arc UNION SELECT graph, j FROM arc),
        o AS (SELECT graph, i, count(*) AS od, avg(r) AS o, list_sort(list(r)) AS c FROM arc GROUP BY 1, 2), p AS (SELECT graph, j AS i, count(*) AS pd, avg(r) AS p, list_sort(list(r)) AS d FROM arc GROUP BY 1, 2),
        row AS (SELECT graph, i, coalesce(od, 0) AS od, coalesce(pd, 0) AS pd, coalesce(o, 0) AS o, coalesce(p, 0) AS p, c[2] - c[1] AS og, d[2] - d[1] AS pg FROM node LEFT JOIN o USING (graph, i) LEFT JOIN p USING (graph, i)),
        by_node AS (SELECT graph, count(*) AS n, {', '.join(f'{v} AS {k}' for k, v in _BY_NODE.items())} FROM row GROUP BY 1),
        by_pair AS (SELECT a.graph, count(*) AS pairs, {', '.join(f'{v} AS {k}' for k, v in _BY_PAIR.items())} FROM arc a JOIN arc b ON a.graph = b.graph AND a.i = b.j AND a.j = b.i AND a.i < a.j GROUP BY 1)
        SELECT graph, {', '.join(f'CAST({sig(k)} AS DOUBLE) AS {k}' for k in _BY_NODE)}, {', '.join(f"CAST({sig(f'coalesce({k}, 0)')} AS DOUBLE) AS {k}" for k in _BY_PAIR)},
          {sig('arcs / (n * (n - 1))')} AS sp_arc_density, {sig('2 * coalesce(pairs, 0) / arcs')} AS sp_reciprocal_arc_fraction, CASE WHEN scale = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sp_all_listed_costs_zero
        FROM by_node JOIN scale USING (graph) LEFT JOIN by_pair USING (graph)""",
}
