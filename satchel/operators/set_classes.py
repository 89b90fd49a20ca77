"""The incidence and bipartite families of sets kept as links: (graph, member, element), in bounded memory.

Elements of the same sets are one class, and so are sets of the same elements. Every feature
comes from the classes, the links between them and the numbers of their nodes; a graph's task
holds these, no node by node matrix. Pairs of classes are counted by their shared and united
nodes, a block of classes against a block, and blocks meet in any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.tasks import stored
from satchel.operators.families import component_labels, spread, stats
from satchel.operators.incidence import WIDE

#: Classes of a block, and cells of its matrix, at most (a block has one class at least).
BLOCK, CELLS = 1024, 1 << 25
#: Columns that a pair of blocks is multiplied by at once; a multiple of 8.
SLICE = 1024
#: Different counts up to which they are summed in place, not sorted.
IN_PLACE = 1 << 22
EMPTY = "!Unsupported: empty_incidence_universe"


def element_classes(links: DataFrame) -> DataFrame:
    """(graph, members, unlinked, n): n elements in the same sets, whose names are sorted.

    A set without a name is one too. The row ``unlinked`` has the sets that came with no element.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("member").cast("string")), F.lit(""))
    sets = links.groupBy("graph", "element").agg(F.array_sort(F.collect_set(name)).alias("members"))
    return sets.groupBy("graph", "members", F.col("element").isNull().alias("unlinked")).agg(F.count(F.lit(1)).alias("n"))


class Graph:
    """Links between a graph's classes of sets (side 0) and of elements (side 1), their nodes and degrees.

    ``ends``: of each link the class of either side; ``times``, ``degree``: of each class, by
    side; ``empty``: the number of sets without elements.
    """

    def __init__(self, table: pa.Table):
        linked = table.filter(pc.invert(table["unlinked"]))
        flat = pa.concat_arrays([x.flatten() for x in linked["members"].chunks] or [pa.array([], pa.string())])
        found = flat.dictionary_encode()
        rest = [x.flatten() for x in table.filter(table["unlinked"])["members"].chunks]
        self.empty = sum(len(x) - (pc.sum(pc.is_in(x, value_set=found.dictionary)).as_py() or 0) for x in rest)
        code, n = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), linked["n"].to_numpy()
        column = np.repeat(np.arange(len(n)), pc.list_value_length(linked["members"]).to_numpy())
        names: dict[bytes, int] = {}
        lists = np.split(column[np.argsort(code, kind="stable")], np.cumsum(np.bincount(code))[:-1]) if code.size else []
        of = np.array([names.setdefault(x.tobytes(), len(names)) for x in lists], dtype=np.int64)
        first = np.zeros(len(of), bool)
        first[np.unique(of, return_index=True)[1]] = True
        self.ends = of[code[first[code]]], column[first[code]]
        self.times = np.bincount(of), n
        self.degree = tuple(np.bincount(self.ends[s], self.times[1 - s][self.ends[1 - s]], len(self.times[s])) for s in (0, 1))

    def blocks(self, side: int, step: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(the classes, of each of their links the class within the block and that of the other side), ``step`` classes at a time."""
        order = np.argsort(self.ends[side], kind="stable")
        own, other = self.ends[side][order], self.ends[1 - side][order]
        for at in range(0, len(self.times[side]), step):
            low, high = np.searchsorted(own, (at, at + step))
            yield slice(at, min(at + step, len(self.times[side]))), own[low:high] - at, other[low:high]

    def singular_values(self) -> np.ndarray:
        """Of the links scaled by the roots of both degrees, those of zero between equal nodes left out.

        Equal nodes are one row or column times the root of their number. Blocks of the longer
        side are brought to a triangle of the shorter one, which keeps small values exact.
        """
        long = int(len(self.times[1]) >= len(self.times[0]))
        scale = [np.sqrt(t / d) for t, d in zip(self.times, self.degree, strict=True)]
        width = len(self.times[1 - long])
        r = np.zeros((0, width))
        for part, i, j in self.blocks(long, max(width, 1024)):
            block = np.zeros((part.stop - part.start, width))
            block[i, j] = scale[long][part][i] * scale[1 - long][j]
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return np.linalg.svd(r, compute_uv=False)

    def features(self, shared: np.ndarray, united: np.ndarray, times: np.ndarray, inside: np.ndarray) -> dict[str, float]:
        """``times`` pairs of nodes of different classes share and unite so many; in ``inside`` of them one holds the other."""
        rows, columns = int(self.times[0].sum()) + self.empty, int(self.times[1].sum())
        deg = np.r_[np.repeat(self.degree[0], self.times[0]), np.zeros(self.empty)], np.repeat(self.degree[1], self.times[1])
        both, edges = np.r_[deg], float(deg[0].sum())
        alike = sum(int((t * (t - 1) // 2).sum()) for t in self.times)
        apart = self.empty * (rows - self.empty) + self.empty * (self.empty - 1) // 2
        jaccard, many = np.r_[shared / united, 1.0, 0.0], np.r_[times, alike, apart]
        pairs = max(int(many.sum()), 1)
        i, j = self.ends
        linked = self.times[0][i] * self.times[1][j]
        leaf = (self.degree[0][i] == 1) | (self.degree[1][j] == 1)
        value = self.singular_values()
        second, energy = (value[1] if value.size > 1 else 0.0), value**2
        part, smaller = energy[energy > 0] / energy.sum(), min(rows, columns)
        label = component_labels(sum(map(len, self.times)), np.stack([i, len(self.times[0]) + j], 1))
        sizes = np.bincount(label, np.concatenate(self.times))
        # every link weighs 1
        weight = stats("incidence_nonzero_weight", [1.0]) | {"incidence_nonzero_weight_count": edges, "incidence_nonzero_weight_unique_ratio": 1 / edges}
        return stats("set_size", deg[0]) | stats("element_degree", deg[1]) | weight | {
            "incidence_group_count": float(rows), "incidence_universe_size": float(columns), "incidence_density": edges / (rows * columns),
        } | spread("graph_relative_degree", np.r_[deg[0] / columns, deg[1] / rows], WIDE) | counted_spread("graph_neighbor_jaccard", jaccard, many, WIDE) | {
            "graph_identical_nonempty_neighborhood_pair_ratio": alike / pairs, "graph_strict_nonempty_containment_pair_ratio": float(inside.sum() / pairs),
            "graph_isolated_node_ratio": float((both == 0).mean()), "graph_leaf_node_ratio": float((both == 1).mean()), "graph_leaf_incident_edge_ratio": float((linked * leaf).sum() / edges),
            "graph_normalized_second_singular_value": float(second), "graph_normalized_spectral_gap": float(value[0] - second),
            "graph_normalized_spectral_effective_rank": float(np.exp(-(part * np.log(part)).sum()) / smaller), "graph_normalized_spectral_energy_mean": float(energy.sum() / smaller),
            "graph_component_count": float((sizes > 0).sum() + self.empty), "graph_largest_component_node_ratio": float(sizes.max() / (rows + columns)),
        }


def counted_spread(name: str, x: np.ndarray, times: np.ndarray, quantiles: tuple) -> dict[str, float]:
    """``spread`` of values that occur so many times; the quantiles are those of all of them."""
    order = np.argsort(x[times > 0])
    x, times = x[times > 0][order], times[times > 0][order]
    if not x.size:
        return spread(name, x, quantiles)
    upto = np.cumsum(times)
    n = int(upto[-1])
    at = np.array(quantiles) * (n - 1)
    low = at.astype(np.int64)
    below, above = (x[np.searchsorted(upto, k, "right")] for k in (low, np.minimum(low + 1, n - 1)))
    mean = float(x @ times / n)
    names = [f"q{round(100 * q):02d}" for q in quantiles] + ["mean", "std"]
    found = [*(below + (above - below) * (at - low)), mean, np.sqrt((x - mean) ** 2 @ times / n)]
    return {f"{name}_{k}": float(v) for k, v in zip(names, found, strict=True)}


def _bits(rows: np.ndarray) -> bytes:
    return np.packbits(rows, axis=1).tobytes()


def _unpacked(bits: bytes, rows: int, at: int, width: int) -> np.ndarray:
    """Up to SLICE columns from ``at`` on."""
    packed = np.frombuffer(bits, np.uint8).reshape(rows, -1)[:, at // 8 : (at + SLICE) // 8]
    return np.unpackbits(packed, axis=1)[:, : width - at].astype(float)


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The different keys and the sums of each of the values, the first of which is positive."""
    if key.max() >= IN_PLACE:
        names, key = np.unique(key, return_inverse=True)
    else:
        names = np.arange(key.max() + 1)
    sums = [np.bincount(key, v) for v in values]
    return [x[sums[0] > 0] for x in (names, *sums)]


def block_pairs(one: dict, two: dict, same: bool) -> list[np.ndarray]:
    """(shared, united, times, inside) of the pairs of two blocks' classes, or of one block with itself."""
    ta, tb, weight = np.frombuffer(one["times"], np.int64), np.frombuffer(two["times"], np.int64), np.frombuffer(one["weights"], np.int64).astype(float)
    shared, da, db = np.zeros((len(ta), len(tb))), np.zeros(len(ta)), np.zeros(len(tb))
    for at in range(0, len(weight), SLICE):
        w = weight[at : at + SLICE]
        a, b = _unpacked(one["bits"], len(ta), at, len(weight)) * w, _unpacked(two["bits"], len(tb), at, len(weight))
        shared, da, db = shared + a @ b.T, da + a.sum(1), db + b @ w
    times, low = np.multiply.outer(ta, tb), np.minimum.outer(da, db)
    inside, united = (shared == low) & np.not_equal.outer(da, db), np.add.outer(da, db) - shared
    if same:
        upper = np.triu(np.ones(shared.shape, bool), 1)
        shared, united, times, inside = shared[upper], united[upper], times[upper], inside[upper]
    if not shared.size:
        return [np.zeros(0, np.int64)] * 4
    most = int(united.max()) + 1
    key, times, inside = _summed((shared * most + united).astype(np.int64).ravel(), times.ravel(), (times * inside).ravel())
    return [key // most, key % most, times.astype(np.int64), inside.astype(np.int64)]


def class_pairs(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph, shared, united, times, inside): the pairs of nodes of different classes on both sides, by what they share and unite."""
    cells = CELLS

    def cut(table: pa.Table) -> pa.Table:
        g, out = Graph(table), []
        for side in (0, 1):
            width = len(g.times[1 - side])
            if len(g.times[side]) < 2:
                continue
            for at, (part, i, j) in enumerate(g.blocks(side, min(block, max(1, cells // width)))):
                rows = np.zeros((part.stop - part.start, width), bool)
                rows[i, j] = True
                out.append({"graph": table["graph"][0].as_py(), "side": side, "at": at, "bits": _bits(rows), "times": g.times[side][part].astype(np.int64).tobytes(), "weights": g.times[1 - side].astype(np.int64).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("graph", pa.string()), ("side", pa.int32()), ("at", pa.int32()), ("bits", pa.binary()), ("times", pa.binary()), ("weights", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        out = []
        for r in table.to_pylist():
            found = block_pairs(r["one"], r["two"], r["a"] == r["b"])
            out.append(pa.table([pa.array([r["graph"]] * len(found[0]), pa.string()), *map(pa.array, found)], ["graph", "shared", "united", "times", "inside"]))
        return pa.concat_tables(out)

    blocks = stored(classes.groupBy("graph").applyInArrow(cut, "graph string, side int, at int, bits binary, times binary, weights binary"), "blocks")
    one = blocks.select("graph", "side", F.col("at").alias("a"), F.struct("bits", "times", "weights").alias("one"))
    two = blocks.select("graph", "side", F.col("at").alias("b"), F.struct("bits", "times").alias("two"))
    # A group is one pair of blocks: no task holds more of them at once. Small in bytes but not in time, so dealt in a fixed number of parts.
    key, parts = ["graph", "side", "a", "b"], int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = one.join(two, ["graph", "side"]).where("a <= b").repartition(parts, *key)
    found = met.groupBy(*key).applyInArrow(count, "graph string, shared long, united long, times long, inside long")
    return found.groupBy("graph", "shared", "united").agg(F.sum("times").alias("times"), F.sum("inside").alias("inside"))


def set_features(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph, feature, value): what ``incidence_counts`` and ``bipartite`` of ``families`` give for each graph's sets.

    Repeated links count once; a link without element names a set that may be empty. A graph
    without elements has a row with the reason for each of both families instead.
    """
    classes = stored(element_classes(links), "classes")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Graph(left)
        found = list(g.features(*(right[k].to_numpy() for k in ("shared", "united", "times", "inside"))).items()) if g.ends[0].size else [(EMPTY, None)] * 2
        names, values = zip(*found, strict=True)
        return pa.table([pa.array([left["graph"][0].as_py()] * len(found), pa.string()), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["graph", "feature", "value"])

    return classes.groupBy("graph").cogroup(class_pairs(classes, block).groupBy("graph")).applyInArrow(finish, "graph string, feature string, value double")
