"""Best-fit packing of token sequences by matching large items.

1. Each document becomes token ids and an end id; documents longer than the capacity are
   cut from the end, so that all pieces but perhaps the first are full.
2. The pieces are counted by length. That histogram has at most as many rows as the
   capacity, whatever the size of the corpus, so the packing is planned on it alone:
   a bin holds at most two items above a third of the capacity, so those are matched
   greedily (the longest with the longest that fits beside it); smaller items, longest
   first, go where they leave the smallest gap.
3. Pieces of a length are interchangeable. Each gets its rank among the pieces of its
   length, and the plan says which bin and offset take that rank.

Ranks come from a two-level prefix sum (row numbers in buckets of rows, plus offsets
from the buckets' counts), so a length that a third of all pieces share is not collected
into one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import materialise

CAPACITY = 2048
#: Rows in a bucket of the two-level ranking, about.
BUCKET_ROWS = 20_000
#: Units in a generation that a worker keeps, and the longest unit kept.
MAX_UNITS, MAX_UNIT_CHARS = 150_000, 48


class UnitEncoder:
    """The ids of whole texts as the library gives them, as little-endian 32-bit bytes.

    The byte-level pre-tokenizer starts a new pre-token at each single space between
    other characters, so the ids of a text are those of its space-separated units, one
    after another, and a unit's ids are asked of the library once. Texts that hold other
    spaces or the special string are given to the library whole.
    """

    def __init__(self, tokenizer, max_units: int = MAX_UNITS):
        self._library, self._most, self._known, self._old = tokenizer, max_units, {}, {}
        vocab = tokenizer.get_vocab()
        self._starts = {i for piece, i in vocab.items() if piece.startswith("Ġ")}
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return pa.array(self._library.encode(text, add_special_tokens=False).ids, pa.uint32()).buffers()[1].to_pybytes() if text else b""

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Asks for many units at once: each one's ids start at an id that starts with a space."""
        out = {}
        groups = [units[i : i + 256] for i in range(0, len(units), 256)]
        for group, got in zip(groups, self._library.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = got.ids
            cuts = [i for i, x in enumerate(ids) if x in self._starts]
            data = pa.array(ids, pa.uint32()).buffers()[1].to_pybytes()
            if len(cuts) != len(group):
                raise ValueError("a unit does not start with a space piece")
            out.update((u, data[4 * a : 4 * b]) for u, a, b in zip(group, cuts, [*cuts[1:], len(ids)], strict=True))
        return out

    def _regular(self, text: str) -> bool:
        return bool(text) and not ("  " in text or text[0].isspace() or text[-1].isspace() or any(s in text for s in self._special))

    def _recall(self, units: set[str]) -> dict[str, bytes]:
        """The units' ids; what is kept is the last and the present generation of units met."""
        known, old = self._known, self._old
        fresh = units - known.keys()
        back = {u: old[u] for u in fresh if u in old}
        learned = self._learn([u for u in fresh if u not in back and not (u[0].isspace() or u[-1].isspace())])
        if len(known) + len(fresh) > self._most:
            self._old, self._known = known, {}
            back |= {u: known[u] for u in units if u in known}
        self._known.update(back)
        self._known.update((u, b) for u, b in learned.items() if len(u) <= MAX_UNIT_CHARS)
        return learned

    def encode(self, texts: list[str]) -> list[bytes]:
        """The first unit has no space before it and is asked for on its own."""
        units = [t.split(" ") if self._regular(t) else None for t in texts]
        learned = self._recall({u for us in units if us for u in us[1:]})
        known = self._known
        firsts = [*{us[0] for us in units if us}]
        heads = dict(zip(firsts, (self._bytes(e.ids) for e in self._library.encode_batch_fast(firsts, add_special_tokens=False)), strict=True))
        out = []
        for text, us in zip(texts, units, strict=True):
            if us is None:
                out.append(self.whole(text))
                continue
            try:
                out.append(heads[us[0]] + b"".join(map(known.__getitem__, us[1:])))
            except KeyError:  # a very long unit, or one with other white space at an end
                odd = any(u[0].isspace() or u[-1].isspace() for u in us)
                out.append(self.whole(text) if odd else heads[us[0]] + b"".join(known[u] if u in known else learned[u] for u in us[1:]))
        return out

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return pa.array(ids, pa.uint32()).buffers()[1].to_pybytes() if ids else b""


@lru_cache(1)
def _encoder(path: str | None) -> UnitEncoder:
    """One per Python worker, kept for its later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return UnitEncoder(Tokenizer.from_file(path))


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cut = n - capacity * ((n - 1) // capacity)  # the first piece's length
                    for k, a in enumerate(range(cut - capacity, n, capacity)):
                        b = a + capacity
                        a = max(a, 0)
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Groups of equally filled bins, by gap. A bin's content: (length, first rank, items, offset)."""

    def __init__(self):
        self.gaps: list[int] = []
        self.by_gap: dict[int, list[tuple[int, tuple]]] = {}

    def add(self, many: int, gap: int, content: tuple) -> None:
        if many:
            if gap not in self.by_gap:
                insort(self.gaps, gap)
                self.by_gap[gap] = []
            self.by_gap[gap].append((many, content))

    def take(self, size: int) -> tuple[int, int, tuple] | None:
        """The group whose gap is the smallest that holds ``size``."""
        i = bisect_left(self.gaps, size)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        many, content = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[i]
        return many, gap, content


def _split(content: tuple, bins: int) -> tuple:
    """The content of the bins that follow the first ``bins`` of a group."""
    return tuple((length, first + bins * items, items, offset) for length, first, items, offset in content)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, items, first_bin, offset).

    The piece of that length with rank r in [rank_from, rank_to) goes to bin
    ``first_bin + (r - rank_from) // items`` at ``offset + (r - rank_from) % items * length``.
    """
    left = {n: k for n, k in histogram.items() if k > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    bins = _Bins()

    def draw(n: int, k: int) -> int:
        first = used[n]
        used[n] += k
        left[n] -= k
        return first

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect_left(large, capacity - a + 1) - 1
            while i >= 0 and (not left[large[i]] or large[i] > a):
                i -= 1
            b = large[i] if i >= 0 else 0
            if b == a and left[a] >= 2:
                k = left[a] // 2
                bins.add(k, capacity - 2 * a, ((a, draw(a, 2 * k), 2, 0),))
            elif b and b != a:
                k = min(left[a], left[b])
                bins.add(k, capacity - a - b, ((a, draw(a, k), 1, 0), (b, draw(b, k), 1, a)))
            else:
                smaller = [x for x in large[: max(i, 0)] if left[x]] if b == a else []
                if smaller:  # one item of this length is left over: its partner is shorter
                    b = smaller[-1]
                    bins.add(1, capacity - a - b, ((a, draw(a, 1), 1, 0), (b, draw(b, 1), 1, a)))
                else:
                    k = left[a]
                    bins.add(k, capacity - a, ((a, draw(a, k), 1, 0),))
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[size]:
            many, gap, content = bins.take(size) or (-(-left[size] // (capacity // size)), capacity, ())
            each, n = gap // size, left[size]
            full = min(many, n // each)
            offset = capacity - gap
            if full:
                bins.add(full, gap - each * size, (*content, (size, draw(size, full * each), each, offset)))
                content, many = _split(content, full), many - full
            if many and left[size] and left[size] < each:
                k = left[size]
                bins.add(1, gap - k * size, (*content, (size, draw(size, k), k, offset)))
                content, many = _split(content, 1), many - 1
            bins.add(many, gap, content)
    rows, first_bin = [], 0
    for gap in bins.gaps:
        for many, content in bins.by_gap[gap]:
            rows += [(length, first, first + many * items, items, first_bin, offset) for length, first, items, offset in content]
            first_bin += many
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a table with a ``length`` column, stored) with sequence_id and offset."""
    spark = cut.sparkSession
    columns = cut.columns
    buckets = max(64, cut.count() // BUCKET_ROWS)
    rows = cut.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    counts = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select("length", "__bucket", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "bucket-offsets")
    histogram = {r[0]: r[1] for r in offsets.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    table = plan(histogram, capacity) or [(0, 0, 0, 1, 0, 0)]
    # A plan has a bounded number of rows: each step of it uses up a length or a group of bins.
    steps = spark.createDataFrame(table, "length long, __from long, __to long, __items long, __bin long, __at long")
    in_bucket = Window.partitionBy("length", "__bucket").orderBy(*columns)
    ranked = rows.withColumn("__row", F.row_number().over(in_bucket) - 1).join(offsets.drop("__n"), ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__row") + F.col("__before"))
    on = (ranked["length"] == steps["length"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    i = F.col("__rank") - F.col("__from")
    return ranked.join(F.broadcast(steps), on).select(
        *(ranked[c] for c in columns), (F.col("__bin") + F.floor(i / F.col("__items"))).alias("sequence_id"), (F.col("__at") + i % F.col("__items") * ranked["length"]).alias("offset")
    )


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    Null and empty texts are one piece, the end id alone. Rows are packed one by one, so
    repeated rows are each packed and null doc_ids pass through. Ties between pieces of
    equal length go by the pieces' columns, so reruns agree. Of an empty table the result
    is empty. Other columns of ``docs`` are not read.
    """
    return pack(materialise(pieces(docs, capacity, tokenizer_path), "pieces"), capacity)
