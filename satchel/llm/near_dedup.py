"""Near-duplicates by minhash and a multi-index Hamming join.

A document's set holds its distinct shingles of so many words; two documents are linked
if their sets' Jaccard similarity is at least the threshold.

1. Sets become signatures of SIGNATURE minima, 16 bits each. Documents with equal sets
   form a class; from here on only classes matter.
2. At similarity 0.8 a minimum of two signatures differs with probability 0.2 at most, and
   more than MOST_ERRORS of 64 with probability about 1e-5. Pairs within that distance
   are all found: the signature is cut into CHUNKS chunks, MOST_ERRORS < 2 * CHUNKS, so in
   some chunk at most one minimum differs, and a key is made of each chunk with each one
   of its minima left out. A key has 48 bits or more, so unrelated classes seldom share one,
   however many there are.
3. Classes that share a key are candidates. Expanding a key's classes into pairs would
   grow with the square of a group of copies, so first each class is compared with one
   centre of its keys, the one it shares the most keys with, then with the next if they
   are still in different components (STAR_ROUNDS).
4. Pairs that share a key but not a component may still be linked. Of a key's classes
   those outside its largest component are compared with all others of the key, in blocks
   of bounded size: first only each class's best one is confirmed, for a few rounds, as
   most that belong together find together so; then all pairs left are confirmed. So no
   link between different components is lost; links inside a component are not needed to
   know it.

Before a candidate's full sets are fetched, an upper bound of its intersection must allow
a link: the sum over BUCKETS ranges of the hash of the smaller one of both sets' counts.
The bound is exact (a shared shingle is in one range for both), so it loses nothing, and
few pairs that are not linked pass it. Links are confirmed on the full sets.

Nothing is collected. Large keys are split into pairs of blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import materialise, spare_name
from satchel.llm.graph import components

SIGNATURE, CHUNKS, MOST_ERRORS = 64, 14, 27
#: Ranges of the hash whose shingles are counted for the upper bound.
BUCKETS = 512
#: Centres that a class is compared with before the pairs left over.
STAR_ROUNDS = 2
#: Rounds in which each class is compared with its best one in another component, before all pairs left over.
NEAREST_ROUNDS = 1
#: Classes of a key on each side of a block of comparisons.
BLOCK = 1_000
#: What a row of a block is: a class of the key's largest component, or another one that is compared with the block's targets, is a target as well, or is a target only.
LARGEST, SOURCE, BOTH, TARGET = range(4)
MAX_WORDS = 400_000
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _chunks() -> list[range]:
    cuts = np.linspace(0, SIGNATURE, CHUNKS + 1).round().astype(int)
    return [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = h
        return h


class Shingler:
    """Shingle sets (sorted 64-bit hashes) and signatures of texts."""

    def __init__(self, width: int):
        self.width, self._hashes = width, _WordHashes()
        rng = np.random.default_rng(7)
        self._flip = rng.integers(0, 2**32, (SIGNATURE, 1), np.uint32)
        self._times = rng.integers(0, 2**32, (SIGNATURE, 1), np.uint32) | np.uint32(1)

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # both for ASCII only
        w = np.fromiter(map(self._hashes.__getitem__, words), np.uint64, len(words))
        if not len(w):
            return w
        width = min(self.width, len(w))
        x = w[: len(w) - width + 1].copy()
        for j in range(1, width):
            x = self._mixed(x * _MIX[2] + np.uint64(width)) + w[j : len(w) - width + 1 + j]
        return np.unique(self._mixed(x + np.uint64(width)))

    def signature(self, x: np.ndarray) -> np.ndarray:
        """For each function the low 16 bits of the smallest value."""
        low, out = (x >> np.uint64(32)).astype(np.uint32), np.full(SIGNATURE, 2**32 - 1, np.uint32)
        for lo in range(0, len(low), 1024):
            y = (low[lo : lo + 1024] ^ self._flip) * self._times
            np.minimum(out, (y ^ (y >> np.uint32(15))).min(1), out=out)
        return (out & np.uint32(65535)).astype(np.uint16)

    @staticmethod
    def buckets(x: np.ndarray) -> np.ndarray:
        """How many shingles are in each range of the hash; all 255 if a number does not fit, which bounds nothing."""
        found = np.bincount((x >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64), minlength=BUCKETS)
        return np.full(BUCKETS, 255, np.uint8) if len(x) and found.max() > 254 else found.astype(np.uint8)


@lru_cache(4)
def _shingler(width: int) -> Shingler:
    """One per Python worker, kept for its later tasks."""
    return Shingler(width)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """row_id, doc_id, text_hash, n, d1, d2 (a digest of the set), sig (the signature and the buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(width)
        for batch in batches:
            n, d1, d2, sigs = [], [], [], []
            for text in batch.column(3):
                x = shingler.shingles(text.as_py())
                n.append(len(x))
                d1.append(int(x.sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(x * _MIX[1] ^ (x >> np.uint64(29)), initial=np.uint64(0)).astype(np.int64)))
                sigs.append(shingler.signature(x).tobytes() + shingler.buckets(x).tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(v, pa.int64()) for v in (n, d1, d2)), pa.array(sigs, pa.binary())], ["row_id", "doc_id", "text_hash", "n", "d1", "d2", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(run, f"row_id long, doc_id {kind}, text_hash long, n long, d1 long, d2 long, sig binary"), "signatures")


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, buckets), a row each."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * SIGNATURE + BUCKETS)
    return rows[:, : 2 * SIGNATURE].copy().view(np.uint16), rows[:, 2 * SIGNATURE :]


def _keys(classes: DataFrame) -> DataFrame:
    """(key, cls): for each chunk and each of its minima a key of the chunk's other minima; its upper 7 bits say which is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _parts(batch.column(1))[0].astype(np.uint64)
            cls = batch.column(0).to_numpy()
            for chunk in _chunks():
                for left_out in chunk:
                    key = np.zeros(len(s), np.uint64)
                    for i in chunk:
                        if i != left_out:
                            key = (key << np.uint64(16)) | s[:, i]  # a chunk has fewer than six minima
                    key = (Shingler._mixed(key) >> np.uint64(7)) | (np.uint64(left_out) << np.uint64(57))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls)], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b, together): each class b with the centres a of its keys, and how many of them a is the centre of.

    A key's centre is its class that shares the most keys with others: the text that
    copies were made from rather than one of the copies.
    """
    degree = shared.groupBy("cls").agg(F.sum("members").alias("degree"))
    ranked = shared.select("key", "cls").join(degree, "cls")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "cls"))["cls"].alias("a"))
    return shared.select("key", F.col("cls").alias("b")).join(centre, "key").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def _alike(n1, n2, percent: int):
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def _distance(n1: np.ndarray, n2: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A lower bound of sets' Jaccard distance in millionths, from their sizes and buckets."""
    shared = np.minimum(h1, h2).sum(1, dtype=np.int64)
    unbounded = (h1[..., 0] == 255) | (h2[..., 0] == 255)
    shared = np.where(unbounded, np.minimum(n1, n2), np.minimum(shared, np.minimum(n1, n2)))
    return (1_000_000 * (n1 + n2 - 2 * shared)) // (n1 + n2 - shared)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes whose sizes and buckets allow a link."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(_alike(F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distance(batch.column(2).to_numpy(), batch.column(3).to_numpy(), *(_parts(batch.column(i))[1] for i in (4, 5)))
            keep = pa.array(np.flatnonzero(d <= 10_000 * (100 - percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _own_key(differ: np.ndarray) -> np.ndarray:
    """Of pairs with a shared key: which minimum the first of their shared keys leaves out. differ: pair x minimum."""
    starts = np.array([c.start for c in _chunks()])
    errors = np.add.reduceat(differ, starts, axis=1)
    chunk = (errors <= 1).argmax(1)
    wrong = differ.argmax(1) if not len(differ) else np.array([int(d[starts[c] :].argmax()) + starts[c] for d, c in zip(differ, chunk, strict=True)])
    return np.where(errors[np.arange(len(chunk)), chunk] == 0, starts[chunk], wrong)


def _crossing(members: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b, d): pairs of one key but of different components that may be linked, each pair at the first of its keys.

    ``nearest``: for each class only the best one of its block. ``members``: see _open_groups.
    """

    def compare(key, role, cls, comp, n, sig, buckets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        left_out = (key[0] >> 57) & 127
        targets = np.flatnonzero(role != SOURCE)
        for i in np.flatnonzero((role == SOURCE) | (role == BOTH)):
            j = targets[(comp[targets] != comp[i]) & ((role[targets] == LARGEST) | (cls[targets] > cls[i]))]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            if len(j):
                differ = sig[j] != sig[i]
                some = differ.sum(1) <= MOST_ERRORS
                j, differ = j[some], differ[some]
            if len(j):
                d = _distance(n[j], n[i], buckets[j], buckets[i])
                some = d <= 10_000 * (100 - percent)
                j, d, differ = j[some], d[some], differ[some]
            if len(j) and nearest:
                j, d = j[[d.argmin()]], d[[d.argmin()]]
            elif len(j):
                own = _own_key(differ) == left_out
                j, d = j[own], d[own]
            if len(j):
                yield np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            group = np.stack([rows.column(i).to_numpy() for i in range(3)])
            starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)]) if rows.num_rows else np.zeros(0, int)
            role, cls, comp, n = (rows.column(i).to_numpy() for i in range(3, 7))
            sig, buckets = _parts(rows.column(7))
            found = [np.zeros((3, 0), np.int64)]
            for s, e in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                found += (np.stack(f).astype(np.int64) for f in compare(group[0, s:e], role[s:e], cls[s:e], comp[s:e], n[s:e], sig[s:e], buckets[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, 1)], ["a", "b", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for i in range(3):
                x = batch.column(i).to_numpy()
                same &= x == x[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if last:
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return members.mapInArrow(run, "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))


def _open_groups(shared: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """key, source_part, target_part, role, cls, comp, n, sig of keys whose classes are in different components.

    The classes outside a key's largest component are dealt to source parts, all of its
    classes to target parts, and each pair of parts is a group of bounded size.
    """
    placed = shared.select("key", "cls").join(comps, "cls")
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    open_keys = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("largest"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    parts = lambda many: F.ceil(many / BLOCK).cast("int")
    open_keys = open_keys.select("key", F.col("largest.comp").alias("largest"), parts(F.col("members") - F.col("largest.size")).alias("sources"), parts(F.col("members")).alias("targets"))
    own = lambda name: F.pmod(F.xxhash64("cls", F.lit(name)), F.col(name)).cast("int")
    members = placed.join(open_keys, "key").withColumn("s", own("sources")).withColumn("t", own("targets"))
    row = lambda s, t, role: F.struct(s.alias("source_part"), t.alias("target_part"), role.cast("int").alias("role"))
    every = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    is_largest = F.col("comp") == F.col("largest")
    role = lambda s: F.when(is_largest, LARGEST).when(s == F.col("s"), BOTH).otherwise(TARGET)
    as_target = F.transform(every("sources"), lambda s: row(s, F.col("t"), role(s)))
    as_source = F.transform(F.filter(every("targets"), lambda t: ~is_largest & (t != F.col("t"))), lambda t: row(F.col("s"), t, F.lit(SOURCE)))
    members = members.select("key", "cls", "comp", F.explode(F.concat(as_target, as_source)).alias("at"))
    members = members.select("key", "at.*", "cls", "comp").join(classes.select("cls", "n", "sig"), "cls").select("key", "source_part", "target_part", "role", "cls", "comp", "n", "sig")
    return members.repartition("key", "source_part", "target_part").sortWithinPartitions("key", "source_part", "target_part")


def _sets(shared: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cls, set): the full sets of the classes that share a key, one text each."""
    needed = shared.select("cls").distinct().join(classes.select("cls", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "cls")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("__h"))
    texts = texts.join(needed, (F.col("__h") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("cls", "text").dropDuplicates(["cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler.shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["cls", "set"])

    return materialise(texts.mapInArrow(run, "cls long, set binary"), "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of stored ``pairs`` that are linked, by their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    joined = pairs.select("a", "b").join(sets.withColumnsRenamed({"cls": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"cls": "b", "set": "y"}), "b")
    return materialise(joined.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long").distinct(), "links")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (cls, comp) after the components that ``links`` (a, b) join have become one."""
    a, b = (comps.select(F.col("cls").alias(x), F.col("comp").alias(f)) for x, f in (("a", "src"), ("b", "dst")))
    edges = links.join(a, "a").join(b, "b").where("src <> dst").select("src", "dst").distinct()
    joined = components(edges).withColumnsRenamed({"node": "comp", "component": "new"})
    return materialise(comps.join(joined, "comp", "left").select("cls", F.coalesce("new", "comp").alias("comp")), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_id for each row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets; the
    component's id is the smallest doc_id in it. Texts with fewer words than ``width``
    have their whole word sequence as only shingle. Texts without words, null ones too,
    have no shingles, are linked with nothing and are kept. Repeated rows and rows with
    equal sets are linked; all rows with the smallest doc_id are marked as kept. A null
    doc_id names a component only if it has no other, and is then kept. Of an empty table
    the result is empty. Columns other than doc_id and text are not read.
    """
    if percent < 80:
        raise ValueError("the signature distance is set for similarities of 80 % and more")
    rows = _signed(docs, width)
    first = F.min(F.struct("row_id", "doc_id", "text_hash", "sig")).alias("first")
    classes = materialise(rows.where("n > 0").groupBy("n", "d1", "d2").agg(first).select(F.col("first.row_id").alias("cls"), "n", "d1", "d2", "first.doc_id", "first.text_hash", "first.sig"), "classes")
    keys = _keys(classes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialise(keys.join(sizes, "key"), "shared-keys")
    sets = _sets(shared, docs, classes, width)
    tried = materialise(_stars(shared), "stars")
    comps = classes.select("cls", F.col("cls").alias("comp"))
    for _ in range(STAR_ROUNDS):
        a, b = (comps.select(F.col("cls").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
        apart = materialise(tried.join(a, "a").join(b, "b").where("comp_a <> comp_b").select("a", "b", "together"), "stars")
        if not apart.head(1):
            break
        best = apart.groupBy("b").agg(F.max(F.struct("together", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        best = materialise(best, "best-stars")
        near = materialise(_near(best, classes, percent), "near-pairs")
        found = _links(near, sets, percent)
        if found.head(1):
            comps = _merged(comps, found)
        tried = apart.join(best, ["a", "b"], "left_anti")
    for round_ in range(NEAREST_ROUNDS + 1):
        last = round_ == NEAREST_ROUNDS
        crossing = materialise(_crossing(_open_groups(shared, comps, classes), percent, nearest=not last), "crossing-pairs")
        if not last:
            ends = crossing.select("a", "b", "d", F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.min(F.struct("d", "a", "b")).alias("best"))
            crossing = materialise(ends.select("best.a", "best.b").distinct(), "nearest-pairs")
        if not crossing.head(1):
            break
        found = _links(crossing, sets, percent)
        if found.head(1):
            comps = _merged(comps, found)
    of_row = rows.join(classes.select("n", "d1", "d2", "cls"), ["n", "d1", "d2"]).select("row_id", "doc_id", "n", "cls")
    of_row = materialise(of_row.join(comps, "cls").select("row_id", "doc_id", "n", "comp"), "row-components")
    ids = materialise(of_row.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "component-ids")
    linked = of_row.join(ids, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row_id")
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with its id."""
    mark = f"{spare_name(docs)}kept"
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
