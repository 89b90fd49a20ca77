"""Collocations by Apriori passes: phrases that occur together more often than apart.

Level k counts the phrases of k words. Before it, the frequent phrases of level k-1 are
broadcast, as a bit set of their hashes whose size is fixed (``MOST_BITS``), whatever the
number of phrases. A pass emits a phrase only when both phrases of k-1 words in it have
their bit set; as every part of a frequent phrase is frequent, none is lost, and a phrase
let through by a hash shared with another is counted exactly and then falls under the
threshold. Phrases are counted in chunks of bounded size inside the tasks, then by a
grouping that combines before the shuffle, so a frequent phrase is no hot key. Scores come
from the level tables by equi-joins.

Defined results: null texts are empty, a null language is ``und``, repeated rows count as
often as they are there, texts are read whole however long. A table without texts, or
without a phrase frequent enough, gives no rows. Other columns, whatever their names, are
not read. Ties of score and count go to the phrase that is first in byte order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from satchel.llm.common import materialise

#: Characters that end a piece; each becomes a word of its own, which no text can hold.
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"."
_TO_END = bytes(END[0] if c in ENDS else c for c in range(256))
#: Bytes of text whose phrases are counted together before they leave a task.
CHUNK = 4 << 20
#: Rows per Arrow batch that a task emits.
ROWS = 1 << 16
#: Bits for each frequent phrase, and the bound on all of them: 16 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 27
#: Groups of phrases in which a language's best are chosen before they meet.
SPREAD = 64

_COUNTS = "lang string, phrase binary, f long"


class _Vocabulary(dict):
    """Words numbered as they come; number 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words and ends of ``text`` in lists from at most about CHUNK bytes each."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > CHUNK:
            to = text.rfind(b" ", at, at + CHUNK)
            to = to if to > at else text.find(b" ", at + CHUNK)
            to = to if to > at else len(text)
        yield text[at:to].split()
        at = to


def _mixed(words: np.ndarray, starts: np.ndarray, crc: np.ndarray, length: int, lang: bytes) -> np.ndarray:
    """64-bit hashes of the phrases of ``length`` words that begin at ``starts``."""
    h = np.full(starts.size, (zlib.crc32(lang) + length) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
    for j in range(length):
        h = (h ^ crc[words[starts + j]]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _phrases(tokens: list[bytes], k: int, lang: bytes, bits: np.ndarray | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases of k words within ``tokens`` and how often they occur."""
    vocabulary = _Vocabulary({END: 0})
    x = np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    words = list(vocabulary)
    starts = np.arange(x.size - k + 1) if x.size >= k else np.arange(0)
    for j in range(k):
        starts = starts[x[starts + j] != 0]
    if bits is not None and starts.size:
        crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
        for j in (0, 1):
            h = _mixed(x, starts + j, crc, k - 1, lang) & np.uint64(bits.size * 8 - 1)
            starts = starts[bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1 != 0]
    if not starts.size:
        return
    name = x[starts]
    for j in range(1, k):
        _, name = np.unique(name << 32 | x[starts + j], return_inverse=True)
    _, first, count = np.unique(name, return_index=True, return_counts=True)
    at = starts[first]
    columns = [[words[i] for i in x[at + j]] for j in range(k)]
    yield (columns[0] if k == 1 else list(map(b" ".join, zip(*columns, strict=True)))), count


def _batches(lang: str, phrases: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), ROWS):
        part = phrases[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(counts[i : i + ROWS], pa.int64())], names=["lang", "phrase", "f"])


def _counter(k: int, bits):
    def count(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            text = END.join(texts).lower().translate(_TO_END).replace(b"\t", b" ").replace(END, b" " + END + b" ")
            carried, seen = [], 0
            for tokens in _slices(text):
                seen += len(tokens) - tokens.count(END)
                tokens = carried + tokens
                for phrases, counts in _phrases(tokens, k, lang.encode(), bits.value if bits else None):
                    yield from _batches(lang, phrases, counts)
                carried = tokens[len(tokens) - k + 1 :] if k > 1 else []
            if k == 1:
                yield from _batches(lang, [b""], np.array([seen]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                text = text.as_py()
                held.setdefault(lang.as_py(), []).append(text)
                size += len(text) + 64
                if size >= CHUNK:
                    yield from count(held)
                    held, size = {}, 0
        yield from count(held)

    return run


def _level(texts: DataFrame, k: int, least: int, bits) -> DataFrame:
    """(lang, phrase, f) of the phrases of k words with f >= least; at level 1 also the empty phrase with the count of all words."""
    counted = texts.mapInArrow(_counter(k, bits), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    kept = counted.where((F.col("f") >= least) | ((F.length("phrase") == 0) & (F.col("f") > 0)))
    return materialise(kept.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), f"phrases{k}")


def _places(k: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.empty(batch.num_rows, dtype=np.int64)
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            phrases = [p.split(b" ") for p in batch["phrase"].to_pylist()]
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                crc = np.array([zlib.crc32(w) for i in rows for w in phrases[i]], dtype=np.uint64)
                h = _mixed(np.arange(crc.size), np.arange(rows.size) * k, crc, k, lang.encode())
                places[rows] = (h & np.uint64(mask)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

    return run


def _bit_set(level: DataFrame, k: int):
    """Broadcast bits of the hashes of a level's phrases, at most MOST_BITS; None for a level without phrases."""
    level = level.where("phrase <> ''")
    size = level.count()
    if not size:
        return None
    wanted = LEAST_BITS
    while wanted < min(BITS_EACH * size, MOST_BITS):
        wanted *= 2
    places = level.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(_places(k, wanted - 1), "place long").withColumn("place", F.col("place") + 1)
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    bits = np.zeros(wanted // 8, dtype=np.uint8)
    for part, found in parts:
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(found, dtype=np.uint8)
    return level.sparkSession.sparkContext.broadcast(bits)


def frequent_phrases(documents: DataFrame, longest: int = 3, least: int = 10) -> list[DataFrame]:
    """For each length from 1 to ``longest`` a stored table (lang, phrase, f) of the phrases with f >= ``least``.

    The table of length 1 also has, under the empty phrase, the number of all words of a language.
    """
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    levels = [_level(texts, 1, least, None)]
    for k in range(2, longest + 1):
        bits = _bit_set(levels[-1], k - 1)
        levels.append(levels[-1].where("false") if bits is None else _level(texts, k, least, bits))
    return levels


def _cut(words: str, first: str, many: str) -> F.Column:
    return F.concat_ws(" ", F.expr(f"slice({words}, {first}, {many})"))


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of 2 to ``longest`` words occurring a >= ``least`` times is cut where
    floor(1000000 a a / (l r)) is lowest, l and r counting its two parts (ties: the
    shortest first part). It falls away when a longer such phrase holds it and occurs at
    least ``share`` per cent as often. Order: score, a descending, then phrase.
    """
    levels = frequent_phrases(documents, longest, least)
    words, candidates = levels[0].where("phrase <> ''"), levels[1].withColumn("k", F.lit(2))
    parts = words
    for k in range(3, longest + 1):
        candidates = candidates.unionByName(levels[k - 1].withColumn("k", F.lit(k)))
        parts = parts.unionByName(levels[k - 2])
    candidates = candidates.withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", _cut("w", "1", "at").alias("first"), _cut("w", "at + 1", "k - at").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(38, 0)) * a * 1000000) div (CAST(l AS DECIMAL(38, 0)) * r)")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("s"))
    # every shorter phrase inside a longer one, with the longer one's count
    held = candidates.where("k > 2").select("lang", "a", "k", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("many"))
    held = held.select("lang", "a", "w", "many", F.explode(F.expr("sequence(1, k - many + 1)")).alias("from")).select("lang", "a", _cut("w", "from", "many").alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(held, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(38, 0)) * 100 < CAST(a AS DECIMAL(38, 0)) * {share}"))
    free = free.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = free.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
