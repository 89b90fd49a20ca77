"""Mixing sources to target weights, block by block.

Each source's words, document after document, form a stream that is packed into blocks
of a fixed number of words. The mix is a number of output shards; for each source the
numbers of its blocks in the shards are a multinomial draw of its quota over the shards,
so that each shard's source counts are multinomial given the quotas, and every quota is
met exactly. The slots of a source are numbered through its shards; slot i takes the
block at place ``i mod n`` of the source's pseudorandom permutation number ``i div n``,
so no block is taken more than once before all have been taken equally often. Slots and
documents are then joined by block index.

All draws are keyed hashes or generators seeded by the source, so reruns agree. A source
that holds a third of all words is spread over row buckets (two-level prefix sums) and
over its blocks and shards; only one row per source is ever handled in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import WORD, materialise, spare_name

#: Words in a block, and blocks in an output shard on average.
BLOCK_WORDS, SHARD_BLOCKS = 32, 8192
#: Shards of slots that a task expands.
TASK_SHARDS = 16
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words; most words as a share of a source's.
SHARE, MOST = 1.5, 2.0
#: Rows in a bucket of the two-level prefix sum, about.
BUCKET_ROWS = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, target) from rows of (source, size).

    Targets are proportional to the weights but stop at ``most`` times the source's
    size; what is above goes to the others by weight. Sources in the order of
    limit / weight are at their limit up to the first whose share of the rest is not
    above it. One row per source is sorted here.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1).cast("long")
    ranked = by_source.select("source", "source_size", number.alias("source_no"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    everything = Window.partitionBy()
    along = Window.orderBy("ratio", "source_no")
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = rest / F.sum("w").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level)
    first_free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)["level"]
    target = F.when(first_free.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * first_free))
    return levels.select("source", "source_no", "source_size", target.alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: four Feistel rounds, walking until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng([key, n]).integers(0, 2**63, 4, np.uint64)

    def walk(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (a << shift) | b

    out = walk(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = walk(out[far])
    return out.astype(np.int64)


def _key(source: str | None, seed: int) -> int:
    return zlib.crc32(b"" if source is None else b"s" + source.encode()) + (seed << 32)


def slots(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(source_no, shard, slot, block) for each slot of the mix.

    ``plan`` has a row per source: source, source_no, blocks, quota.
    """
    whole = F.sum("quota").over(Window.partitionBy())
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(whole / F.lit(shard_blocks))))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rng, first, group = np.random.default_rng([_key(r.source, seed), 1]), 0, 4096
                widths = [min(group, r.shards - i) for i in range(0, r.shards, group)]
                for i, (k, width) in enumerate(zip(rng.multinomial(r.quota, np.array(widths) / r.shards), widths, strict=True)):
                    n = rng.multinomial(k, np.full(width, 1 / width))
                    yield pd.DataFrame({"source": r.source, "source_no": r.source_no, "blocks": r.blocks, "shard": i * group + np.arange(width), "first": first + n.cumsum() - n, "n": n})
                    first += int(k)

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                slot = np.arange(r.first, r.first + r.n, dtype=np.int64)
                block = np.empty_like(slot)
                for epoch in np.unique(slot // r.blocks):
                    here = slot // r.blocks == epoch
                    block[here] = permuted(slot[here] % r.blocks, r.blocks, _key(r.source, seed) + (int(epoch) << 33))
                yield pd.DataFrame({"source_no": r.source_no, "shard": r.shard, "slot": slot, "block": block})

    drawn = plan.where("quota > 0").select("source", "source_no", "blocks", "quota", "shards").mapInPandas(draw, "source string, source_no long, blocks long, shard long, first long, n long")
    total = plan.agg(F.sum("quota")).head()[0] or 0
    parts = max(1, -(-total // (TASK_SHARDS * shard_blocks)))  # given, as the few small rows grow when expanded
    return drawn.where("n > 0").repartition(int(parts), "source_no", "shard").mapInPandas(expand, "source_no long, shard long, slot long, block long")


def _placed(docs: DataFrame, keep: tuple[str, ...], weights, share: float, most: float, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their place in their source's stream, the plan with a row per source)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row_id"), *keep, F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("target") >= most * F.col("source_size"), most * n_blocks).otherwise(F.least(most * n_blocks, F.round(F.col("target") / block_words)))
    plan = materialise(targets(rows, weights, share, most).select("*", n_blocks.alias("blocks"), quota.cast("long").alias("quota")), "mix-plan")
    buckets = max(64, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("before") + F.col("within"))
    numbers = plan.select(F.col("source").alias("p"), "source_no", "source_size", "target")
    rows = rows.join(numbers, F.col("source").eqNullSafe(F.col("p"))).select("row_id", *keep, "source_no", "size", "source_size", "target", "start")
    return materialise(rows, "placed"), plan


def _cut(placed: DataFrame, block_words: int) -> DataFrame:
    """(row_id, source_no, block, first, words): the words of each row that are in each block."""
    end = F.col("start") + F.col("size")
    cut = placed.where("size > 0").select("row_id", "source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    return cut.select("row_id", "source_no", "block", (low - F.col("start")).alias("first"), (F.least(end, (F.col("block") + 1) * block_words) - low).alias("words"))


def _taken_spans(placed: DataFrame, plan: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """(row_id, first, words, times, shard): which words of a row are taken how often, and the first shard they are drawn into."""
    times = slots(plan, shard_blocks, seed).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    # The slots grow out of a row per source, which the planner would take for a small table.
    return _cut(placed, block_words).join(times.hint("merge"), ["source_no", "block"]).select("row_id", "first", "words", "times", "shard")


def mixed_blocks(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """shard, source_no, slot, block, doc_id, first, words: what each output shard holds.

    A row for each document that has words in a drawn block: ``words`` words from word
    ``first`` on. How many blocks of a source a shard holds is its multinomial draw; which
    ones says the source's permutation. Nulls, ties, repeats and empty tables as in mix.
    """
    placed, plan = _placed(docs, ("doc_id",), weights, share, most, block_words)
    cut = _cut(placed, block_words).join(placed.select("row_id", "doc_id"), "row_id")
    return cut.join(slots(plan, shard_blocks, seed).hint("merge"), ["source_no", "block"]).select("shard", "source_no", "slot", "block", "doc_id", "first", "words")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard for each row of ``docs``.

    ``first_shard`` is the first output shard that the draws put words of the row into,
    null if none are taken; ``mixed_blocks`` has all of them.

    Null texts have no words, null sources are a source of their own, after the others.
    A source with fewer words than half a block may be left out or taken whole, as its
    quota of blocks rounds. Repeated rows are mixed each on its own; rows that share a
    doc_id and size are ordered arbitrarily, but hold the same words if they are equal.
    If no text has words, targets and taken are 0; of an empty table the result is
    empty. Other columns of ``docs`` are not read.
    """
    placed, plan = _placed(docs, ("doc_id",), weights, share, most, block_words)
    spans = _taken_spans(placed, plan, block_words, shard_blocks, seed)
    taken = spans.groupBy("row_id").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    return placed.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each time a document is taken.

    Its text is the document's, or the words taken that time, if not all; n_chars, if
    there, is its length. Documents of which nothing is taken are left out.
    """
    p = spare_name(docs)
    rows = materialise(docs.select("*", F.monotonically_increasing_id().alias(f"{p}row")), "mix-input")
    keyed = rows.select("doc_id", "text", "source", F.col(f"{p}row").alias("mix_row"))
    placed, plan = _placed(keyed, ("doc_id", "mix_row"), weights, share, most, block_words)
    spans = _taken_spans(placed, plan, block_words, shard_blocks, seed)
    spans = spans.select("row_id", "first", "words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass"))
    passes = spans.groupBy("row_id", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias(f"{p}spans"), F.sum("words").alias(f"{p}words"))
    passes = passes.join(placed.select("row_id", F.col("mix_row").alias(f"{p}row"), F.col("size").alias(f"{p}size")), "row_id").drop("row_id", "pass")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    some = F.ltrim(F.array_join(F.flatten(F.transform(f"{p}spans", lambda s: F.slice(words, s["first"].cast("int") + 1, s["words"].cast("int")))), ""))
    out = rows.join(passes, f"{p}row").withColumn("text", F.when(F.col(f"{p}words") == F.col(f"{p}size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
