"""Features of weighted graphs kept as a relation of arcs: (graph, i, j, cost), a row per arc.

Any number of graphs share one table. Reverse arcs come from an equi-join on swapped
nodes, nearest nodes from ranks, triangles from joins on shared nodes, spanning trees from
rounds of joins that contract components. All sums combine before they are shuffled, so no
graph has to fit in a task or a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions.tasks import stored

TINY = 1e-12
#: What counts as a long or short arc against the mean, and the share of cheap arcs.
LONG, SHORT, LOW = 1.5, 0.5, 0.25
SHAPE = ("mean", "cv", "skew", "kurtosis", "range_ratio", "long", "short", "tie")
PATH_PARTS = ("outgoing_mean", "incoming_mean", "mean_cost_imbalance", "outgoing_minimum_gap", "incoming_minimum_gap", "reciprocal_cost_difference")


def swapped(arcs: DataFrame, cost: str = "back") -> DataFrame:
    return arcs.select("graph", F.col("j").alias("i"), F.col("i").alias("j"), F.col("cost").alias(cost))


def nodes_of(arcs: DataFrame) -> DataFrame:
    """(graph, i): all ends of arcs."""
    return arcs.select("graph", "i").unionByName(arcs.select("graph", F.col("j").alias("i"))).distinct()


def completed(arcs: DataFrame, default: float) -> DataFrame:
    """Arcs between all two nodes of each graph; those that are not there cost ``default``."""
    nodes = nodes_of(arcs)
    every = nodes.join(nodes.withColumnRenamed("i", "j"), "graph").where("i <> j")
    return every.join(arcs, ["graph", "i", "j"], "left").select("graph", "i", "j", F.coalesce("cost", F.lit(default)).alias("cost"))


def tour_faults(arcs: DataFrame, symmetric: bool = False) -> DataFrame:
    """(graph, n, reason): reason is null where the arcs are those of a tour instance.

    It needs one arc for each ordered pair of different nodes, three nodes (four where
    ``symmetric``), and costs that are finite and not negative. Arcs from a node to
    itself do not count.
    """
    proper = arcs.where("i <> j")
    size = nodes_of(proper).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    sound = F.coalesce((F.col("cost") >= 0) & (F.col("cost") < float("inf")), F.lit(False))
    pairs = proper.groupBy("graph", "i", "j").agg(F.count(F.lit(1)).alias("times"), F.bool_and(sound).alias("sound"), F.max("cost").alias("cost"))
    if symmetric:
        pairs = pairs.join(swapped(pairs), ["graph", "i", "j"], "left").withColumn("same", F.coalesce(F.col("cost") == F.col("back"), F.lit(False)))
    seen = pairs.groupBy("graph").agg(F.count(F.lit(1)).alias("pairs"), F.max("times").alias("times"), F.bool_and("sound").alias("sound"), *([F.bool_and("same").alias("same")] if symmetric else []))
    reason = F.when(F.col("n") < (4 if symmetric else 3), "too_few_nodes").when((F.col("pairs") < F.col("n") * (F.col("n") - 1)) | (F.col("times") > 1), "costs_incomplete_or_repeated").when(~F.col("sound"), "costs_not_finite_or_negative")
    reason = reason.when(~F.col("same"), "not_symmetric") if symmetric else reason
    return size.join(seen, "graph").select("graph", "n", reason.alias("reason"))


def _sound(arcs: DataFrame, symmetric: bool) -> tuple[DataFrame, DataFrame]:
    """Stored arcs of the graphs without a fault, and these graphs' numbers of nodes."""
    arcs = stored(arcs.where("i <> j").select("graph", "i", "j", F.col("cost").cast("double").alias("cost")), "arcs")
    faults = stored(tour_faults(arcs, symmetric), "graphs")
    sizes = faults.where("reason IS NULL").select("graph", "n")
    return (arcs.join(sizes.select("graph"), "graph", "left_semi") if faults.where("reason IS NOT NULL").head(1) else arcs), sizes


def cv(x: str) -> Column:
    """Deviation by the absolute mean, 0 for a mean of 0 or no values."""
    return F.when(F.abs(F.avg(x)) > TINY, F.stddev_pop(x) / F.abs(F.avg(x))).otherwise(0.0)


def eccentricity(x: str) -> Column:
    return F.when(F.abs(F.avg(x)) > TINY, F.max(x) / F.abs(F.avg(x))).otherwise(0.0)


def cost_shape(arcs: DataFrame) -> DataFrame:
    """Per graph the shape of its costs: mean, cv, skew, kurtosis, range, long and short shares, ties."""
    flat = F.coalesce(F.stddev_pop("cost"), F.lit(0.0)) <= TINY
    whole = arcs.groupBy("graph").agg(
        F.avg("cost").alias("mean"), cv("cost").alias("cv"), F.when(flat, 0.0).otherwise(F.skewness("cost")).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis("cost")).alias("kurtosis"),
        (F.max("cost") - F.min("cost")).alias("range"), F.count(F.lit(1)).alias("arcs"),
    )
    # each different cost once, with how often it occurs
    values = arcs.groupBy("graph", "cost").agg(F.count(F.lit(1)).alias("times")).join(whole.select("graph", "mean"), "graph")
    tails = values.groupBy("graph").agg(
        F.count(F.lit(1)).alias("different"), F.sum(F.when(F.col("cost") >= LONG * F.col("mean"), F.col("times")).otherwise(0)).alias("long"), F.sum(F.when(F.col("cost") <= SHORT * F.col("mean"), F.col("times")).otherwise(0)).alias("short")
    )
    some, n = F.abs("mean") > TINY, F.col("arcs")
    return whole.join(tails, "graph").select(
        "graph", "mean", "cv", "skew", "kurtosis", F.when(some, F.col("range") / F.abs("mean")).otherwise(0.0).alias("range_ratio"),
        F.when(some, F.col("long") / n).otherwise(0.0).alias("long"), F.when(some, F.col("short") / n).otherwise(0.0).alias("short"), (1 - F.col("different") / n).alias("tie"),
    )


def nearest_two(arcs: DataFrame) -> DataFrame:
    """(graph, i, mean, first, second, near_ratio): of each node's arcs the mean cost, the two least costs, and the ratio of these."""
    rank = F.row_number().over(Window.partitionBy("graph", "i").orderBy("cost", "j"))
    two = arcs.withColumn("k", rank).where("k <= 2").groupBy("graph", "i").agg(F.min("cost").alias("first"), F.max(F.when(F.col("k") == 2, F.col("cost"))).alias("second"))
    mean = arcs.groupBy("graph", "i").agg(F.avg("cost").alias("mean"))
    return mean.join(two, ["graph", "i"]).withColumn("near_ratio", F.when(F.abs("second") > TINY, F.col("first") / F.col("second")).otherwise(1.0))


def _near(nodes: DataFrame, prefix: str) -> DataFrame:
    """Per graph what ``nearest_two`` says of its nodes."""
    found = nodes.groupBy("graph").agg(F.avg("first").alias("first"), cv("first").alias("first_cv"), F.avg("near_ratio").alias("near_ratio"), cv("mean").alias("mean_cv"), eccentricity("mean").alias("eccentricity"))
    return found.select("graph", *(F.col(c).alias(f"{prefix}{c}") for c in found.columns[1:]))


def _by_mean(x: Column) -> Column:
    return F.when(F.abs("mean") > TINY, x / F.abs("mean")).otherwise(0.0)


def directed_features(arcs: DataFrame) -> DataFrame:
    """The 25 features of directed tour instances, a row per graph; graphs with a fault (``tour_faults``) are left out."""
    arcs, sizes = _sound(arcs, False)
    both = arcs.join(swapped(arcs), ["graph", "i", "j"])
    flat = (F.coalesce(F.stddev_pop("cost"), F.lit(0.0)) <= TINY) | (F.coalesce(F.stddev_pop("back"), F.lit(0.0)) <= TINY)
    same = F.bool_and(F.col("cost") == F.col("back"))
    gap = F.when(F.col("i") < F.col("j"), F.abs(F.col("cost") - F.col("back")))
    pairs = both.withColumn("gap", gap).groupBy("graph").agg(
        F.avg("gap").alias("gap_mean"), F.max("gap").alias("gap_max"), cv("gap").alias("gap_cv"), F.avg((F.col("gap") == 0).cast("double")).alias("gap_equal"),
        F.when(flat, F.when(same, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.covar_pop("cost", "back"), F.stddev_pop("cost") * F.stddev_pop("back"))).alias("correlation"),
    )
    out, into = nearest_two(arcs), nearest_two(swapped(arcs, "cost"))
    means = out.select("graph", "i", F.col("mean").alias("a")).join(into.select("graph", "i", F.col("mean").alias("b")), ["graph", "i"])
    apart = means.groupBy("graph").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    row = sizes.join(cost_shape(arcs), "graph").join(pairs, "graph").join(_near(out, "out_"), "graph").join(_near(into, "in_"), "graph").join(apart, "graph")
    unit = F.greatest(F.abs("mean"), F.lit(TINY))
    return row.select(
        "graph", F.col("n").cast("double").alias("n"), F.col("mean").alias("directed_cost_mean"), F.col("cv").alias("directed_cost_cv"), F.col("skew").alias("directed_cost_skew"), F.col("kurtosis").alias("directed_cost_kurtosis"),
        F.col("range_ratio").alias("directed_cost_range_ratio"), F.col("long").alias("directed_long_edge_ratio"), F.col("short").alias("directed_short_edge_ratio"), F.col("tie").alias("directed_tie_ratio"),
        _by_mean(F.col("out_first")).alias("out_nearest_mean_ratio"), F.col("out_first_cv").alias("out_nearest_cv"), _by_mean(F.col("in_first")).alias("in_nearest_mean_ratio"), F.col("in_first_cv").alias("in_nearest_cv"),
        F.col("out_near_ratio").alias("out_first_second_ratio"), F.col("in_near_ratio").alias("in_first_second_ratio"), F.col("out_mean_cv").alias("outgoing_mean_cv"), F.col("in_mean_cv").alias("incoming_mean_cv"),
        (F.col("apart") / unit).alias("in_out_mean_gap_ratio"), F.col("out_eccentricity").alias("outgoing_node_eccentricity"), F.col("in_eccentricity").alias("incoming_node_eccentricity"),
        (F.col("gap_mean") / unit).alias("reciprocal_abs_gap_mean_ratio"), (F.col("gap_max") / unit).alias("reciprocal_abs_gap_max_ratio"), F.col("gap_cv").alias("reciprocal_abs_gap_cv"),
        F.col("correlation").alias("reciprocal_cost_correlation"), F.col("gap_equal").alias("reciprocal_equal_ratio"),
    )


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(graph, i, j, cost) of the edges of a least spanning forest, by rounds of contraction.

    In each round every component takes its cheapest edge to another (ties by the edge's
    ends, so that no cycle closes), the components so linked become one, and of several
    edges between two components the cheapest stays. A round at least halves the
    components of each graph; all graphs go through the same rounds.
    """
    cheapest = F.min(F.struct("cost", "i", "j")).alias("e")
    ends = [F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")]
    left = edges.where("i <> j").select("graph", *ends, F.col("cost").cast("double").alias("cost")).select("graph", F.col("i").alias("a"), F.col("j").alias("b"), "cost", "i", "j")
    left, taken = stored(left.groupBy("graph", "a", "b").agg(cheapest), "edges"), None
    empty = left.where("false").select("graph", "e.i", "e.j", "e.cost")
    while left.head(1):
        both = left.unionByName(left.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = stored(both.groupBy("graph", "a").agg(F.min(F.struct("e", "b")).alias("least")).select("graph", "a", "least.b", "least.e"))
        chosen = best.select("graph", "e.i", "e.j", "e.cost").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        # Each component points to the one it chose; the smaller of two that chose each other is a root.
        other = best.select("graph", F.col("a").alias("b"), F.col("b").alias("next"))
        roots = stored(best.join(other, ["graph", "b"]).select("graph", "a", F.when((F.col("next") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("root")))
        while True:
            via = roots.select("graph", F.col("a").alias("root"), F.col("root").alias("far"))
            jumped = stored(roots.join(via, ["graph", "root"]).select("graph", "a", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            roots = jumped.drop("moved")
            if not jumped.where("moved").head(1):
                break
        named = left.join(roots.withColumnRenamed("root", "x"), ["graph", "a"]).join(roots.select("graph", F.col("a").alias("b"), F.col("root").alias("y")), ["graph", "b"]).where("x <> y")
        left = stored(named.groupBy("graph", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e")))
    return empty if taken is None else taken


def triangle_excess(arcs: DataFrame) -> DataFrame:
    """(graph, violations, excess): ordered triples of different nodes with c[i,k] > c[i,j] + c[j,k], and the mean excess of these.

    Costs are symmetric, so each way is looked at in one direction. Ways that cost as much
    as the dearest arc of the graph are no violation and are dropped before the third arc
    is joined.
    """
    most = arcs.groupBy("graph").agg(F.max("cost").alias("most"))
    one = arcs.join(most, "graph").where("cost < most")
    two = arcs.select("graph", F.col("i").alias("j"), F.col("j").alias("k"), F.col("cost").alias("next"))
    ways = one.join(two, ["graph", "j"]).where("i < k AND cost + next < most").select("graph", "i", "k", F.col("cost").alias("c1"), F.col("next").alias("c2"))
    direct = arcs.where("i < j").select("graph", "i", F.col("j").alias("k"), "cost")
    found = ways.join(direct, ["graph", "i", "k"]).withColumn("excess", F.col("cost") - F.col("c1") - F.col("c2")).where("excess > 0")
    return found.groupBy("graph").agg((2 * F.count(F.lit(1))).alias("violations"), F.avg("excess").alias("excess"))


def symmetric_features(arcs: DataFrame) -> DataFrame:
    """The 22 features of symmetric tour instances, a row per graph; graphs with a fault (``tour_faults``) are left out.

    The low-cost graph holds the edges up to the 25th percentile of costs. The edges of
    the least spanning tree among them join exactly its components, which gives their number.
    """
    arcs, sizes = _sound(arcs, True)
    edges = arcs.where("i < j")
    low = edges.groupBy("graph").agg(F.percentile("cost", F.lit(LOW)).alias("low"), F.count(F.lit(1)).alias("edges"))
    cheap = F.col("cost") <= F.col("low")
    tree = spanning_forest(edges).join(low, "graph").groupBy("graph").agg(F.sum("cost").alias("tree"), cv("cost").alias("tree_cv"), F.count_if(cheap).alias("joined"))
    degrees = arcs.join(low, "graph").groupBy("graph", "i").agg(F.count_if(cheap).alias("degree")).groupBy("graph").agg(cv("degree").alias("degree_cv"), (F.sum("degree") / 2).alias("cheap"))
    nodes = nearest_two(arcs)
    least = nodes.select("graph", "i", "first")
    mutual = arcs.join(least, ["graph", "i"]).where("cost = first").join(least.select("graph", F.col("i").alias("j"), F.col("first").alias("back")), ["graph", "j"])
    mutual = mutual.groupBy("graph").agg(F.avg((F.col("cost") == F.col("back")).cast("double")).alias("mutual"))
    row = sizes.join(cost_shape(edges), "graph").join(_near(nodes, ""), "graph").join(tree, "graph").join(degrees, "graph").join(low, "graph").join(mutual, "graph").join(triangle_excess(arcs), "graph", "left")
    unit, n = F.greatest(F.abs("mean"), F.lit(TINY)), F.col("n").cast("double")
    return row.select(
        "graph", n.alias("n"), F.col("mean").alias("edge_cost_mean"), F.col("cv").alias("edge_cost_cv"), F.col("skew").alias("edge_cost_skew"), F.col("kurtosis").alias("edge_cost_kurtosis"), F.col("range_ratio").alias("edge_cost_range_ratio"),
        F.col("long").alias("edge_long_ratio"), F.col("short").alias("edge_short_ratio"), F.col("tie").alias("edge_tie_ratio"), _by_mean(F.col("first")).alias("nearest_mean_ratio"), F.col("first_cv").alias("nearest_cv"), F.col("near_ratio").alias("first_second_ratio"),
        F.col("mean_cv").alias("node_mean_cv"), F.col("eccentricity").alias("node_eccentricity"), (F.coalesce("violations", F.lit(0)) / (n * (n - 1) * (n - 2))).alias("triangle_violation_ratio"), (F.coalesce("excess", F.lit(0.0)) / unit).alias("triangle_violation_mean_ratio"),
        (F.col("tree") / F.greatest((n - 1) * unit, F.lit(TINY))).alias("mst_weight_ratio"), F.col("tree_cv").alias("mst_edge_cv"), (F.col("cheap") / F.col("edges")).alias("low_cost_graph_density"), ((n - F.col("joined")) / n).alias("low_cost_component_ratio"),
        F.col("degree_cv").alias("low_cost_degree_cv"), F.col("mutual").alias("nearest_reciprocity"),
    )


def seven(x: str, prefix: str) -> list[Column]:
    """Quartiles, mean and deviation of a column's values that are not null; of none all 0."""
    found = [F.percentile(x, F.lit(q)).alias(f"{prefix}_q{round(100 * q):02d}") for q in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return [*found, F.avg(x).alias(f"{prefix}_mean"), F.stddev_pop(x).alias(f"{prefix}_std")]


def path_features(arcs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The 49 features of path instances, a row per graph with an arc between different nodes.

    ``nodes`` (graph, i) may hold nodes without arcs. Arcs may be missing; costs are taken
    relative to the mean absolute cost.
    """
    arcs = stored(arcs.where("i <> j").select("graph", "i", "j", F.col("cost").cast("double").alias("cost")), "arcs")
    scale = arcs.groupBy("graph").agg(F.avg(F.abs("cost")).alias("scale"), F.count(F.lit(1)).alias("arcs"))
    arcs = arcs.join(scale.select("graph", "scale"), "graph").select("graph", "i", "j", F.when(F.col("scale") > 0, F.col("cost") / F.col("scale")).otherwise(0.0).alias("cost"))
    nodes = (nodes_of(arcs) if nodes is None else nodes.select("graph", "i").unionByName(nodes_of(arcs)).distinct()).join(scale.select("graph"), "graph", "left_semi")
    degree = arcs.groupBy("graph", "i").agg(F.count(F.lit(1)).alias("degree"))
    back = swapped(arcs, "cost")
    into = back.groupBy("graph", "i").agg(F.count(F.lit(1)).alias("in_degree"))
    out_two = nearest_two(arcs).select("graph", "i", F.col("mean").alias("out"), (F.col("second") - F.col("first")).alias("out_gap"))
    in_two = nearest_two(back).select("graph", "i", F.col("mean").alias("into"), (F.col("second") - F.col("first")).alias("in_gap"))
    rows = nodes
    for part in (degree, into, out_two, in_two):
        rows = rows.join(part, ["graph", "i"], "left")
    rows = rows.fillna(0, ["degree", "in_degree", "out", "into"]).withColumn("apart", F.abs(F.col("out") - F.col("into")))
    by_node = rows.groupBy("graph").agg(
        F.count(F.lit(1)).alias("n"), *(c for x, name in zip(("out", "into", "apart", "out_gap", "in_gap"), PATH_PARTS, strict=False) for c in seven(x, f"sp_{name}")),
        *(F.avg(test.cast("double")).alias(f"sp_{name}_arc_node_fraction") for name, test in (("no_outgoing", F.col("degree") == 0), ("no_incoming", F.col("in_degree") == 0), ("two_outgoing", F.col("degree") >= 2), ("two_incoming", F.col("in_degree") >= 2))),
    )
    mutual = arcs.where("i < j").join(swapped(arcs), ["graph", "i", "j"]).withColumn("apart", F.abs(F.col("cost") - F.col("back")))
    by_pair = mutual.groupBy("graph").agg(F.count(F.lit(1)).alias("pairs"), *seven("apart", f"sp_{PATH_PARTS[5]}"))
    row = by_node.join(scale, "graph").join(by_pair, "graph", "left")
    row = row.withColumns({
        "sp_arc_density": F.col("arcs") / (F.col("n") * (F.col("n") - 1)), "sp_reciprocal_arc_fraction": 2 * F.coalesce("pairs", F.lit(0)) / F.col("arcs"), "sp_all_listed_costs_zero": (F.col("scale") == 0).cast("double"),
    })
    return row.select("graph", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in row.columns if c.startswith("sp_")))
