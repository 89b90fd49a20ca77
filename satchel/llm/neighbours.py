"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. A few random orders of the nodes (by the sides of random
hyperplanes, then along a random direction) are cut into blocks; all nodes of a block are
compared, which gives every node a first list of neighbours. Then NN-descent: each node
introduces its neighbours, and the nodes that have it as neighbour, to each other, and
every node keeps its nearest; a round is a join of the lists with the vectors, one local
comparison per node, and a merge of the lists. The search keeps a pool of the nearest
nodes found for each query, starting at the query's own node, and expands the pool's
nearest nodes by the graph until none is left to expand.

Lists, pools and blocks have a fixed length, so work and memory grow with the number of
vectors. The hyperplanes' offsets are medians over a bounded sample; every row is indexed.
Distances of the result are computed in double precision from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import materialise

#: Length of a node's list; neighbours and reverse neighbours it introduces; rounds at most.
LIST, INTRODUCED, ROUNDS = 32, 24, 5
#: Nearest of the newly met that a node reports for each common neighbour.
REPORTED = 8
#: Random orders, and nodes in a block of one.
ORDERS, BLOCK = 8, 1024
#: Nodes that the hyperplanes' offsets are fitted on.
SAMPLE_NODES = 10_000
#: Pool of a query; nodes expanded in a round; rounds at most.
POOL, EXPANDED, SEARCH_ROUNDS = 128, 20, 40


def _double(vector):
    return F.transform(vector, lambda x: x.cast("double"))


def _floats(column: pa.Array, kind: str = "f4") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "f8").reshape(len(rows), -1).astype(kind) if rows else np.zeros((0, 0), kind)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, with their vectors as double arrays."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), _double(F.col(vector_col)).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0 is 0


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = [np.array(x, "f8").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["vec_id", "vec"])


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest (node, nbr, d) of each node, each neighbour once."""
    best = edges.groupBy("node", "nbr").agg(F.min("d").alias("d"))
    order = Window.partitionBy("node").orderBy("d", "nbr")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_lists(nodes: DataFrame, orders: int, block: int, k: int) -> DataFrame:
    spark = nodes.sparkSession
    many = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE_NODES).select("vec").toPandas()["vec"]
    x = np.stack([np.frombuffer(v, "f8") for v in sample])
    bits = min(50, max(0, int(np.ceil(np.log2(max(many, 1) / block)))))
    planes = np.random.default_rng(11).normal(size=(orders, x.shape[1], bits + 1))
    offsets = np.median(np.einsum("nd,tdb->tnb", x, planes), axis=1)
    fitted = spark.sparkContext.broadcast((planes, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, offsets = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _floats(batch.column(1), "f8")
            for t in range(len(planes)):
                sides = v @ planes[t] - offsets[t]
                key = (sides[:, :-1] > 0) @ (1 << np.arange(sides.shape[1] - 1, dtype=np.int64)) if sides.shape[1] > 1 else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(key.astype(np.int64)), pa.array(sides[:, -1]), batch.column(0), batch.column(1)], ["t", "key", "pos", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of consecutive rows; a short last block is joined to the one before."""

        def lists(table: pa.Table) -> pa.RecordBatch:
            ids, v = table.column(0).to_numpy(), _floats(table.column(1))
            d = ((v * v).sum(1)[:, None] + (v * v).sum(1) - 2 * v @ v.T).clip(0)
            d[ids[:, None] == ids] = np.inf  # a block over the ends of two orders may hold a node twice
            n = min(k, len(ids) - 1)
            at = np.argpartition(d, n - 1, axis=1)[:, :n] if n > 0 else np.zeros((len(ids), 0), int)
            near = np.take_along_axis(d, at, 1).ravel().astype("f8")
            other = near < np.inf
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[other]), pa.array(ids[at].ravel()[other]), pa.array(near[other])], ["node", "nbr", "d"])

        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            while waiting >= 2 * block:
                table = pa.Table.from_batches(held)
                yield lists(table.slice(0, block))
                held = table.slice(block).combine_chunks().to_batches()
                waiting -= block
        if waiting:
            yield lists(pa.Table.from_batches(held))

    placed = nodes.select("node", "vec").mapInArrow(place, "t int, key long, pos double, node long, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, many * orders // (8 * block)))
    ordered = placed.repartitionByRange(parts, "t", "key", "pos").sortWithinPartitions("t", "key", "pos")
    return _nearest(ordered.select("node", "vec").mapInArrow(compare, "node long, nbr long, d double"), k)


def _introduce(graph: DataFrame, nodes: DataFrame, introduced: int, k: int) -> DataFrame:
    """(node, nbr, d): pairs met at a common neighbour that are nearer than the end of one's list."""
    ends = graph.groupBy("node").agg(F.max("d").alias("end"), F.count(F.lit(1)).alias("n")).select("node", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("end")).alias("end"))
    near = graph.where(F.col("rank") <= introduced).select("node", "nbr", "d")
    back = _nearest(near.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d"), introduced).drop("rank")
    meets = near.unionByName(back).select(F.col("node").alias("host"), F.col("nbr").alias("node")).distinct()
    guests = meets.join(nodes.join(ends, "node"), "node").select("host", "node", "end", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            host, ids, end = (table.column(i).to_numpy() for i in range(3))
            v = _floats(table.column(3))
            starts = np.flatnonzero(np.r_[True, host[1:] != host[:-1]])
            sizes = np.diff(np.r_[starts, len(host)])
            a, b, ds = [], [], []
            for size in np.unique(sizes):
                if size < 2:
                    continue
                at = starts[sizes == size][:, None] + np.arange(size)
                x = v[at]
                q = (x * x).sum(2)
                d = (q[:, :, None] + q[:, None, :] - 2 * x @ x.transpose(0, 2, 1)).clip(0)
                d[:, np.arange(size), np.arange(size)] = np.inf
                top = min(REPORTED, size - 1)
                by = np.argpartition(d, top - 1, axis=2)[:, :, :top]
                near = np.take_along_axis(d, by, 2)
                g, i, r = np.nonzero(near < end[at][:, :, None])
                a.append(ids[at[g, i]]), b.append(ids[at[g, by[g, i, r]]]), ds.append(near[g, i, r].astype("f8"))
            if not a:
                a, b, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, ds)], ["node", "nbr", "d"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            host = batch.column(0).to_numpy()
            cut = int(np.searchsorted(host != host[-1], False)) if host[0] == host[-1] else int(np.flatnonzero(host != host[-1])[-1]) + 1
            if cut:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return guests.repartition("host").sortWithinPartitions("host").mapInArrow(run, "node long, nbr long, d double")


def build_graph(nodes: DataFrame, k: int = LIST, rounds: int = ROUNDS, orders: int = ORDERS, block: int = BLOCK, introduced: int = INTRODUCED) -> DataFrame:
    """(node, nbr, d, rank): the k nearest neighbours found of each node (d: squared distance)."""
    graph = materialise(_first_lists(nodes, orders, block, k), "graph")
    many = graph.count()
    for _ in range(rounds if many else 0):
        better = materialise(_nearest(graph.select("node", "nbr", "d").unionByName(_introduce(graph, nodes, introduced, k)), k), "graph")
        kept = better.join(graph.select("node", "nbr"), ["node", "nbr"]).count()
        graph = better
        if kept >= 0.98 * better.count():
            break
    return graph


def _measure(pairs: DataFrame) -> DataFrame:
    """(q, node, d): exact distances of pairs with qv and vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(((_floats(batch.column(2), "f8") - _floats(batch.column(3), "f8")) ** 2).sum(1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["q", "node", "d"])

    return pairs.select("q", "node", "qv", "vec").mapInArrow(run, "q long, node long, d double")


def search_graph(graph: DataFrame, nodes: DataFrame, starts: DataFrame, pool: int = POOL, expanded: int = EXPANDED, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """(q, node, d): the pool of nearest nodes found for each query.

    ``starts``: q, node, vec; a query is a node of the graph and starts there.
    """
    both = graph.select("node", "nbr").unionByName(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), F.col("d")).transform(lambda e: _nearest(e, LIST)).select("node", "nbr")).distinct()
    both = materialise(both, "both-ways")
    vectors = materialise(starts.select("q", F.col("vec").alias("qv")), "queries")
    found = materialise(starts.select("q", "node", F.lit(0.0).alias("d"), F.lit(False).alias("done")), "pool")
    by_q, open_first = Window.partitionBy("q").orderBy("d", "node"), Window.partitionBy("q", "done").orderBy("d", "node")
    for _ in range(rounds):
        marked = found.withColumn("go", ~F.col("done") & (F.row_number().over(open_first) <= expanded))
        going = materialise(marked, "pool")
        reached = going.where("go").join(both, "node").select("q", F.col("nbr").alias("node")).distinct().join(going.select("q", "node"), ["q", "node"], "left_anti")
        fresh = _measure(reached.join(nodes.select("node", "vec"), "node").join(vectors, "q")).withColumn("done", F.lit(False))
        merged = going.select("q", "node", "d", (F.col("done") | F.col("go")).alias("done")).unionByName(fresh)
        found = materialise(merged.withColumn("r", F.row_number().over(by_q)).where(F.col("r") <= pool).drop("r"), "pool")
        if not found.where("NOT done").head(1):
            break
    return found.select("q", "node", "d")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but the
    query's own. score is the Euclidean distance; ties go to the smaller vec_id. Rows with
    a null id or vector, with null or non-finite components, or with the zero vector take
    no part. Rows with equal vectors are found together; repeated rows are candidates
    each, and a query that is repeated is answered once and has its repetitions as
    candidates. With fewer than k candidates all are returned; of an empty table, or
    without queries, the result is empty. Vectors must have one length. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    stored = materialise(rows.mapInArrow(_packed, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vec binary"), "vectors")
    nodes = materialise(stored.select("vec").distinct().select(F.monotonically_increasing_id().alias("node"), "vec"), "nodes")
    empty = spark.createDataFrame([], f"query_id {stored.schema['vec_id'].dataType.simpleString()}, rank int, vec_id {stored.schema['vec_id'].dataType.simpleString()}, score double")
    if not stored.where(F.col("vec_id") % every == 0).head(1):
        return empty
    members = stored.join(nodes, "vec").select("node", "vec_id", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    first = lambda w: F.row_number().over(w.orderBy("vec_id")) <= k + 1
    members = materialise(members, "members")
    lowest = members.withColumn("keep", first(Window.partitionBy("node", "salt"))).where("keep").withColumn("keep", first(Window.partitionBy("node"))).where("keep").select("node", "vec_id")
    asked = members.where(F.col("vec_id") % every == 0).select("node", F.col("vec_id").alias("query_id")).distinct()
    queries = materialise(asked.join(nodes, "node").select("query_id", "node", "vec"), "asked")
    starts = queries.select(F.col("node").alias("q"), "node", "vec").dropDuplicates(["q"])
    pools = search_graph(build_graph(nodes), nodes, starts)
    near = Window.partitionBy("q").orderBy("d", "node")
    pools = pools.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("q", "node", "d")
    hits = queries.select("query_id", F.col("node").alias("q")).join(pools, "q").join(lowest, "node").select("query_id", "vec_id", F.col("d").alias("score"))
    # The query's own row is taken out once, also where it is repeated.
    ranked = hits.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("score"))).where(~((F.col("vec_id") == F.col("query_id")) & (F.col("own") == 1)))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
