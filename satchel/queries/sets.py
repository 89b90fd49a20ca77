"""Which suppliers of a nation deliver parts of which brand: sets of suppliers by brand, a graph per nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators import incidence
from satchel.queries.common import rounded, sig, stats_sql


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "part", "supplier"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.concat(F.lit("nation_"), F.coalesce(F.col("s_nationkey").cast("string"), F.lit("none"))).alias("graph"), F.col("p_brand").alias("member"), F.col("l_suppkey").alias("element")).distinct()


def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(incidence.incidence_counts(links(spark, sf_dir)))


def set_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(incidence.overlap_features(links(spark, sf_dir)))


def set_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values are not SQL; tested against a dense decomposition."""
    return rounded(incidence.spectral_features(links(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (set_counts, set_overlaps, set_spectrum)}

_LINKS = """WITH RECURSIVE links AS (SELECT DISTINCT 'nation_' || coalesce(CAST(s_nationkey AS VARCHAR), 'none') AS graph, p_brand AS member, l_suppkey AS element FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
  m AS (SELECT graph, member, count(*) AS degree FROM links GROUP BY 1, 2), e AS (SELECT graph, element, count(*) AS degree FROM links GROUP BY 1, 2),
  size AS (SELECT graph, (SELECT count(*) FROM m WHERE m.graph = g.graph) AS r, (SELECT count(*) FROM e WHERE e.graph = g.graph) AS c, count(*) AS edges FROM links g GROUP BY 1)"""
_WIDE = (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)


def _moments(table: str, name: str) -> str:
    return f"SELECT graph, {', '.join(stats_sql(name, f'CAST({name} AS DOUBLE)'))} FROM (SELECT graph, degree AS {name}, avg(degree) OVER g AS {name}_m, stddev_pop(degree) OVER g AS {name}_d FROM {table} WINDOW g AS (PARTITION BY graph)) GROUP BY graph"


def _spread(name: str, x: str) -> str:
    found = {f"q{round(100 * q):02d}": f"quantile_cont({x}, {q})" for q in _WIDE} | {"mean": f"avg({x})", "std": f"stddev_pop({x})"}
    return ", ".join(f"{sig(f'coalesce({v}, 0)')} AS graph_{name}_{k}" for k, v in found.items())


#: All pairs of sets, those without common elements too.
_PAIRS = " UNION ALL ".join(
    f"SELECT x.graph, x.degree AS a, y.degree AS b, (SELECT count(*) FROM links p JOIN links q ON p.graph = q.graph AND p.{o} = q.{o} WHERE p.graph = x.graph AND p.{k} = x.{k} AND q.{k} = y.{k}) AS s FROM {t} x JOIN {t} y ON x.graph = y.graph AND x.{k} < y.{k}"
    for t, k, o in (("m", "member", "element"), ("e", "element", "member"))
)

ORACLE = {
    "set_counts": f"""{_LINKS} SELECT * FROM ({_moments('m', 'set_size')}) JOIN ({_moments('e', 'element_degree')}) USING (graph)
        JOIN (SELECT graph, {sig('r')} AS incidence_group_count, {sig('c')} AS incidence_universe_size, {sig('edges / (r * c)')} AS incidence_density FROM size) USING (graph)""",
    "set_overlaps": f"""{_LINKS}, degree AS (SELECT graph, degree, degree / c AS share FROM m JOIN size USING (graph) UNION ALL SELECT graph, degree, degree / r FROM e JOIN size USING (graph)),
        pair AS (SELECT *, s / (a + b - s) AS j FROM ({_PAIRS})),
        step AS (SELECT DISTINCT x.graph, x.member AS a, y.member AS b FROM links x JOIN links y ON x.graph = y.graph AND x.element = y.element),
        reach(graph, a, b) AS (SELECT graph, member, member FROM m UNION SELECT r.graph, r.a, s.b FROM reach r JOIN step s ON r.graph = s.graph AND r.b = s.a),
        part AS (SELECT graph, a AS member, min(b) AS part FROM reach GROUP BY 1, 2),
        parts AS (SELECT graph, part, count(DISTINCT member) + count(DISTINCT element) AS nodes FROM part JOIN links USING (graph, member) GROUP BY 1, 2),
        d AS (SELECT graph, {_spread('relative_degree', 'share')}, {sig('avg(CAST(degree = 0 AS INT))')} AS graph_isolated_node_ratio, {sig('avg(CAST(degree = 1 AS INT))')} AS graph_leaf_node_ratio FROM degree GROUP BY 1),
        j AS (SELECT graph, {_spread('neighbor_jaccard', 'j')}, {sig('avg(CAST(s > 0 AND s = a AND s = b AS INT))')} AS graph_identical_nonempty_neighborhood_pair_ratio, {sig('avg(CAST(s > 0 AND s = least(a, b) AND a <> b AS INT))')} AS graph_strict_nonempty_containment_pair_ratio FROM pair GROUP BY 1),
        l AS (SELECT graph, {sig('avg(CAST(m.degree = 1 OR e.degree = 1 AS INT))')} AS graph_leaf_incident_edge_ratio FROM links JOIN m USING (graph, member) JOIN e USING (graph, element) GROUP BY 1),
        k AS (SELECT graph, {sig('count(*)')} AS graph_component_count, {sig('max(nodes) / any_value(r + c)')} AS graph_largest_component_node_ratio FROM parts JOIN size USING (graph) GROUP BY 1)
        SELECT * FROM d JOIN j USING (graph) JOIN l USING (graph) JOIN k USING (graph)""",
}
