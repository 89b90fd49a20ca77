"""Importance resampling: documents drawn the likelier, the more their words look like a target's.

Features are runs of words, hashed into buckets. The work goes through a dictionary of
distinct features, so that none is hashed or sent once for each time it occurs:

1. ``packed``: the documents as numbers of words, in chunks of bounded size with their own
   sorted words, stored (a row per chunk).
2. ``dictionary``: each chunk's distinct features and counts go, in sorted blocks, to the
   part that owns them. A part counts its features over all chunks, hashes each distinct
   string once, adds up its buckets, and says for each block which buckets its features
   have; stored.
3. ``bucket_counts``: the parts' bucket sums, added up: as many rows as there are buckets.
4. ``weights``: a chunk meets the blocks with its features' buckets again, looks the gains
   up and sums them over the features of each document.

A feature comes once from a chunk, however frequent it is, and a part or chunk is the most
that a task holds at a time (with the shuffle partitions sized to the data, as usual).

Defined results: null and empty texts have no features, weight 0 and are never drawn;
repeated rows are documents of their own and may all be drawn; texts are read whole; an
empty table gives no rows, an empty target leaves T = t = 0. Ties of score go to the
smaller doc_id, then (equal rows) to any. A null doc_id is hashed as the empty string.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from satchel.llm.common import materialise

BUCKETS = 10000
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Parts of the dictionary for each shuffle partition.
PARTS = 3
#: What is not a word's: ASCII other than letters and digits. A full stop stands between documents.
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_BREAK = b"."


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, held, size, number = TaskContext.get().partitionId(), [], 0, 0

    def row() -> pa.RecordBatch:
        words, tokens = numbered([t for _, t in held])
        columns = [pa.array([task << 32 | number], pa.int64()), pa.array([[i for i, _ in held]], pa.list_(kind)), pa.array([words], pa.binary()), pa.array([tokens], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "words", "tokens"])

    for batch in batches:
        kind = batch["doc_id"].type
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            held.append((doc_id.as_py(), (text.as_py() or b"").lower().translate(_TO_SPACE)))
            size += len(held[-1][1]) + 64
            if size >= CHUNK:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


def numbered(texts: list[bytes]) -> tuple[bytes, bytes]:
    """The texts' different words in order, and all words by their places in it, counted from 1; 0 stands between texts."""
    tokens = (b" " + _BREAK + b" ").join(texts).split()
    words = [_BREAK, *sorted(set(tokens) - {_BREAK})]
    place = dict(zip(words, range(len(words)), strict=True))
    x = np.fromiter(map(place.__getitem__, tokens), dtype="<i4", count=len(tokens))
    return zlib.compress(b" ".join(words), 1), zlib.compress(x.tobytes(), 1)


def packed(documents: DataFrame) -> DataFrame:
    """(chunk, ids, words, tokens), stored: the documents of each chunk as ``numbered`` words."""
    given = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return materialise(given.mapInArrow(_packer, f"chunk long, ids array<{kind}>, words binary, tokens binary"), "packed")


class Features:
    """Distinct features of a chunk in sorted order of their words: single words, then longer runs, and where they occur."""

    def __init__(self, words: bytes, tokens: bytes, longest: int):
        self.words = zlib.decompress(words).split(b" ")
        x = np.frombuffer(zlib.decompress(tokens), dtype="<i4").astype(np.int64)
        self.documents = int((x == 0).sum()) + 1
        document = np.cumsum(x == 0)
        crc = np.fromiter(map(zlib.crc32, self.words), dtype=np.uint64, count=len(self.words))
        starts, name, run = np.flatnonzero(x), x[x != 0] - 1, np.arange(1, len(self.words))[None]
        count = np.bincount(name, minlength=run.size)
        #: By occurrence: the feature's number and the document. By feature: its count, words and a number that is equal in all chunks.
        feature, owner, counts, self.runs, keys, total = [], [], [], [], [], 0
        for length in range(1, longest + 1):
            if length > 1:
                inside = starts + length <= x.size
                inside[inside] = x[starts[inside] + length - 1] != 0
                starts, name = starts[inside], name[inside]
                code, name, count = np.unique(name << 32 | x[starts + length - 1], return_inverse=True, return_counts=True)
                run = np.concatenate([run[:, code >> 32], (code & 0xFFFFFFFF)[None]])
            key = np.full(count.size, length, dtype=np.uint64)
            for word in run:
                key = (key ^ crc[word]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            feature.append(name + total)
            owner.append(document[starts])
            counts.append(count)
            self.runs.append(run)
            keys.append(key)
            total += count.size
        self.feature, self.owner, self.counts, self.keys = map(np.concatenate, (feature, owner, counts, keys))
        self.n_words = np.bincount(owner[0], minlength=self.documents)

    def strings(self) -> np.ndarray:
        out = np.empty(self.counts.size, dtype=object)
        at = 0
        for run in self.runs:
            columns = [[self.words[i] for i in c] for c in run]
            out[at : at + run.shape[1]] = columns[0] if len(columns) == 1 else list(map(b" ".join, zip(*columns, strict=True)))
            at += run.shape[1]
        return out

    def by_part(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each part with its features' numbers, in order."""
        part = (self.keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        for p, at in zip(found.tolist(), np.split(order, first[1:]), strict=False):  # no features, no parts
            yield p, at


def _blocks(longest: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, tokens in zip(batch["chunk"].to_pylist(), batch["words"], batch["tokens"], strict=True):
                found = Features(words.as_py(), tokens.as_py(), longest)
                strings, counts = found.strings(), found.counts.astype("<i4")
                rows = [(p, chunk, zlib.compress(b"\n".join(strings[at]), 1), zlib.compress(counts[at].tobytes(), 1)) for p, at in found.by_part(parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "chunk", "strings", "counts"])

    return run


class _Dictionary(dict):
    """Features of a part: a number for each distinct string, which is hashed once, when it is first met."""

    def __init__(self, buckets: int):
        self.buckets, self.new, self.bucket, self.count = buckets, [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __missing__(self, feature: bytes) -> int:
        self[feature] = number = len(self)
        self.new.append(zlib.crc32(feature) % self.buckets)
        return number

    def add(self, features: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Adds distinct features' counts; their buckets."""
        at = np.fromiter(map(self.__getitem__, features), dtype=np.int64, count=len(features))
        if self.new:
            self.bucket = np.concatenate([self.bucket, np.array(self.new, dtype=np.int64)])
            self.count = np.concatenate([self.count, np.zeros(len(self.new), dtype=np.int64)])
            self.new = []
        self.count[at] += counts
        return self.bucket[at]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that have a feature, and their counts: no more than there are features."""
        found, at = np.unique(self.bucket, return_inverse=True)
        out = np.zeros(found.size, dtype=np.int64)
        np.add.at(out, at, self.count)
        return found, out


_NAMED = pa.schema({"part": pa.int64(), "chunk": pa.int64(), "buckets": pa.binary(), "hit": pa.list_(pa.int64()), "n": pa.list_(pa.int64())})


def _named(buckets: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _NAMED.types, strict=True)], schema=_NAMED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owner = None, None
        for batch in batches:
            out = []
            for part, chunk, strings, counts in zip(*(batch[c] for c in ("part", "chunk", "strings", "counts")), strict=True):
                if part.as_py() != owner:
                    if held is not None:
                        out.append((None, None, None, *held.sums()))
                    held, owner = _Dictionary(buckets), part.as_py()
                named = held.add(zlib.decompress(strings.as_py()).split(b"\n"), np.frombuffer(zlib.decompress(counts.as_py()), dtype="<i4"))
                out.append((owner, chunk.as_py(), zlib.compress(named.astype("<u4").tobytes(), 1), None, None))
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([(None, None, None, *held.sums())])

    return run


def dictionary(chunks: DataFrame, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(part, chunk, buckets, hit, n), stored: each block's buckets, and for each part a row with the buckets that it has and their counts."""
    parts = PARTS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = chunks.select("chunk", "words", "tokens").mapInArrow(_blocks(longest, parts), "part long, chunk long, strings binary, counts binary")
    dealt = blocks.repartition("part").sortWithinPartitions("part")
    return materialise(dealt.mapInArrow(_named(buckets), "part long, chunk long, buckets binary, hit array<long>, n array<long>"), "dictionary")


def bucket_counts(named: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket; no more than ``buckets`` rows reach the driver."""
    rows = named.where("hit IS NOT NULL").select(F.explode(F.arrays_zip("hit", "n")).alias("s")).select(F.col("s.hit").alias("bucket"), "s.n").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, over B buckets."""
    b = source.size
    return np.floor(1000 * np.log((target + 1.0) * (source.sum() + b) / ((source + 1.0) * (target.sum() + b)))).astype(np.int64)


def weights(chunks: DataFrame, named: DataFrame, gain: np.ndarray, longest: int = 2) -> DataFrame:
    """(chunk, place, doc_id, n_words, n_features, weight), a row per document."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    parts = PARTS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(chunk: pa.Table, blocks: pa.Table) -> pa.Table:
        ids = chunk["ids"].combine_chunks()
        found = Features(chunk["words"][0].as_py(), chunk["tokens"][0].as_py(), longest)
        said = dict(zip(blocks["part"].to_pylist(), blocks["buckets"].to_pylist(), strict=True))
        value = np.zeros(found.counts.size, dtype=np.int64)
        for p, at in found.by_part(parts):
            value[at] = gain[np.frombuffer(zlib.decompress(said[p]), dtype="<u4")]
        n, total = np.zeros(found.documents, dtype=np.int64), np.zeros(found.documents, dtype=np.int64)
        np.add.at(n, found.owner, 1)
        np.add.at(total, found.owner, value[found.feature])  # a feature's gain as often as the document has it
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        size = found.documents
        return pa.table({"chunk": pa.array([chunk["chunk"][0].as_py()] * size, pa.int64()), "place": pa.array(np.arange(size)), "doc_id": ids.flatten(), "n_words": pa.array(found.n_words), "n_features": pa.array(n), "weight": pa.array(weight)})

    blocks = named.where("chunk IS NOT NULL").select("chunk", "part", "buckets")
    return chunks.groupBy("chunk").cogroup(blocks.groupBy("chunk")).applyInArrow(join, f"chunk long, place long, doc_id {kind}, n_words long, n_features long, weight long")


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """Stored ``rows`` with their rank in ``order``: ranks in range partitions, plus what comes before each of them."""
    sliced = materialise(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("size"))  # a row per partition
    before = sizes.select("slice", (F.sum("size").over(Window.orderBy("slice")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    return sliced.withColumn("rank", place).join(F.broadcast(before), "slice").withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("slice", "before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row per document; ``rank`` is null for those not drawn.

    The score adds Gumbel noise, hashed from the seed and doc_id, to the weight; the
    highest floor(percent N / 100) of the N documents with ``least_words`` are drawn.
    """
    chunks = packed(documents)
    named = dictionary(chunks, longest, buckets)
    wanted = bucket_counts(dictionary(packed(target.select(F.lit(0).alias("doc_id"), "text")), longest, buckets), buckets)
    weighed = weights(chunks, named, gains(bucket_counts(named, buckets), wanted), longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weighed.withColumn("score", score.cast("long")), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    ranked = _numbered(scored.where(fit), [F.desc("score"), F.asc("doc_id"), F.asc("chunk"), F.asc("place")])
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
