"""Toxicity by class-conditional Kneser-Ney models.

Two unigram models, a toxic and an ordinary one, share their smoothed counts:

    p_c(w) = p(w) * share_c(w) / S_c,    S_c = sum of p(w) * share_c(w) over all words,

so each is a distribution over words. Counts are Kneser-Ney continuation counts, of the
different words before a word, so a passage copied a thousand times counts once. share_c
is the class's share of a word's count, discounted toward the share of what the word
backs off to,

    word -> its first 6, 5, 4, 3 characters -> the class's share of all.

A class's count n is first moved to what the backoff's share lets expect, e, by the
absolute discount D * (1 + sqrt(e)); the odds that are left are moved toward the
backoff's by the factor LEAST_ODDS. So rare expressions take their odds from the shared
counts they back off to. A text's score compares its two log-likelihoods, each divided by
its length (and PRIOR_WORDS neutral words); one rising function, fitted by two-fold
cross-fitting, makes a probability of the difference.

The counts come from a bounded sample of labelled rows and are summed by Spark; only
expressions that carry evidence of their own reach the driver. Every text is scored whole.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm import logistic
from satchel.llm.common import materialise

#: Labelled rows of each class that the models are fitted on, at most.
SAMPLE_ROWS = 6_000
THRESHOLD = 0.7
#: D above, the odds that must be exceeded, and the least share of its expected count that a class keeps.
DISCOUNT, LEAST_ODDS, FLOOR = 2.0, 3.0, 0.01
#: Lengths of the beginnings that rare and unseen words back off to.
BEGINNINGS = (3, 4, 5, 6)
#: Neutral words added to a text's length, so a word or two do not decide.
PRIOR_WORDS = 20
WORDS = re.compile(r"\w+")
#: The expression that all others back off to.
ROOT = 0
#: The counts of an expression: class 0 and 1 in both folds together, in fold 0 and in fold 1.
COUNTS = ["n0", "n1", "n0_f0", "n1_f0", "n0_f1", "n1_f1"]


class Index(dict):
    """Ids of expressions (words and beginnings); other words have the id of their longest beginning."""

    def __init__(self, texts: list[str], begins: list[bool], most: int = 300_000):
        """Ids are places in the lists; place 0 is the root."""
        self.beginnings = {t: i for i, (t, b) in enumerate(zip(texts, begins, strict=True)) if b and i}
        super().__init__((t, i) for i, (t, b) in enumerate(zip(texts, begins, strict=True)) if not b and i)
        self._most = len(self) + most

    def back(self, word: str) -> int:
        for k in reversed(BEGINNINGS):
            if len(word) >= k and (i := self.beginnings.get(word[:k])):
                return i
        return ROOT

    def __missing__(self, word: str) -> int:
        i = self.back(word)
        if len(self) < self._most:
            self[word] = i
        return i


def shares(n: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The toxic share of each expression. n: expression x class, row 0 the totals; parent[i] has a smaller depth than i."""
    log_odds = np.zeros(len(n))
    log_odds[ROOT] = np.log((n[ROOT, 1] + 0.5) / (n[ROOT, 0] + 0.5))
    for d in range(1, depth.max() + 1 if len(depth) else 1):
        at = np.flatnonzero(depth == d)
        up = log_odds[parent[at]]
        part = 1 / (1 + np.exp(-up))
        expected = n[at].sum(1)[:, None] * np.stack([1 - part, part], 1)
        away = n[at] - expected
        left = np.maximum(np.abs(away) - DISCOUNT * (1 + np.sqrt(expected)), 0)
        kept = np.maximum(expected + np.sign(away) * left, FLOOR * expected) / np.maximum(expected, 1e-12)
        more = np.log(np.maximum(kept[:, 1], 1e-12)) - np.log(np.maximum(kept[:, 0], 1e-12))
        log_odds[at] = up + np.sign(more) * np.maximum(np.abs(more) - np.log(LEAST_ODDS), 0)
    return 1 / (1 + np.exp(-log_odds))


class ClassModels:
    """``against[i]``: expression i's log-probability under the toxic model and under the ordinary one, less that under the shared one."""

    def __init__(self, against: np.ndarray):
        self.against = against

    @classmethod
    def fit(cls, n: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> ClassModels:
        s = shares(n, parent, depth)
        own = n.sum(1).astype(float)  # the words that an expression stands for: its own count without that of expressions below it
        np.subtract.at(own, parent[1:], n[1:].sum(1))
        p = np.maximum(own, 0) / max(own.clip(0).sum(), 1)
        if not p.sum():
            p[ROOT] = 1
        both = np.stack([s, 1 - s], 1)
        return cls((np.log(both) - np.log(p @ both)).astype("f4"))


def _bend(x: np.ndarray) -> np.ndarray:
    return np.stack([np.sign(x) * np.sqrt(np.abs(x)), np.ones(len(x))], 1)


class ToxicityModel:
    """``weights`` of the calibration: slope (never negative) and intercept."""

    def __init__(self, texts: list[str], begins: list[bool], models: ClassModels, weights: np.ndarray):
        self.texts, self.begins, self.models, self.weights = texts, begins, models, weights
        self.index = Index(texts, begins)

    @classmethod
    def flat(cls, share: float) -> ToxicityModel:
        """Without evidence: every text has the score ``share``."""
        return cls([""], [True], ClassModels(np.zeros((1, 2), "f4")), np.array([0.0, np.log(share / (1 - share))]))

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """text x (toxic, ordinary): log-likelihoods against the shared model, divided by the lengths."""
        words = [WORDS.findall(t.lower()) for t in texts]
        get, sizes = self.index.__getitem__, np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(sizes.sum()))
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(self.models.against[ids].astype(float), axis=0)])
        ends = np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]) / (sizes + PRIOR_WORDS)[:, None]

    def difference(self, texts: list[str]) -> np.ndarray:
        both = self.log_likelihoods(texts)
        return both[:, 0] - both[:, 1]

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_bend(self.difference(texts)) @ self.weights, -30, 30)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        texts = np.frombuffer("\n".join(self.texts).encode(), np.uint8)
        np.savez_compressed(out, texts=texts, begins=np.array(self.begins), against=self.models.against, weights=self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ToxicityModel:
        x = np.load(io.BytesIO(data))
        return cls(x["texts"].tobytes().decode().split("\n"), x["begins"].tolist(), ClassModels(x["against"]), x["weights"])


def _expressions(sample: DataFrame) -> pd.DataFrame:
    """(text, begins, *COUNTS): words and beginnings whose counts exceed the discount, and the root; in the order of their ids."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = WORDS.findall(text.as_py().lower())
                found = [*{*zip(words, ["", *words])}]  # each word with the one before
                before = pa.array([xxhash.xxh3_64_intdigest(v) - 2**63 for _, v in found], pa.int64())
                same = lambda x: pa.array([x.as_py()] * len(found), pa.int32())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), before, same(toxic), same(fold)], ["word", "before", "toxic", "fold"])

    found = sample.select("text", "toxic", "fold").mapInArrow(pairs, "word string, before long, toxic int, fold int")
    found = found.groupBy("word", "before", "toxic").agg(F.max((F.col("fold") == 0).cast("int")).alias("f0"), F.max((F.col("fold") == 1).cast("int")).alias("f1"))
    is_class = [(F.col("toxic") == c).cast("long") for c in (0, 1)]
    counts = [F.sum(x).alias(a) for x, a in zip([*is_class, *(x * F.col(f) for f in ("f0", "f1") for x in is_class)], COUNTS, strict=True)]
    words = materialise(found.groupBy("word").agg(*counts), "continuation-counts")
    beginnings = F.array(F.lit(""), *(F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in BEGINNINGS))
    more = words.select(F.explode(F.array_compact(beginnings)).alias("text"), F.lit(True).alias("begins"), *COUNTS)
    both = words.select(F.col("word").alias("text"), F.lit(False).alias("begins"), *COUNTS).unionByName(more)
    summed = both.groupBy("text", "begins").agg(*(F.sum(c).alias(c) for c in COUNTS)).where((F.col("n0") + F.col("n1") > DISCOUNT) | (F.col("begins") & (F.col("text") == "")))
    out = summed.toPandas()  # bounded by the sample
    out["size"] = out.text.str.len()
    return out.sort_values(["begins", "size", "text"], ascending=[False, True, True], ignore_index=True)


def _fit(docs: DataFrame, labels: DataFrame, sample_rows: int) -> bytes:
    totals = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}  # two rows
    parts = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # twice sample_rows rows at most
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")
    #: Of the rows that share an id the greatest text, so that there are no more rows than chosen ids.
    sample = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    sample = materialise(sample.select("doc_id", "text", "toxic", fold.alias("fold")), "toxicity-sample")
    seen = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}  # two rows
    every = sum(totals.values())
    share = (totals.get(1, 0) + 1) / (every + 2)
    if len(seen) < 2:
        return ToxicityModel.flat(share).to_bytes()
    expressions = _expressions(sample)
    texts, begins = expressions.text.tolist(), expressions.begins.tolist()
    index = Index(texts, begins)
    parent = np.array([ROOT, *(index.back(t[:-1] if b else t) for t, b in zip(texts[1:], begins[1:], strict=True))], np.int64)
    depth = np.zeros(len(texts), np.int64)
    for i in range(1, len(texts)):
        depth[i] = depth[parent[i]] + 1
    counts = expressions[COUNTS].to_numpy(float)
    whole, *folds = (ToxicityModel(texts, begins, ClassModels.fit(counts[:, 2 * k : 2 * k + 2], parent, depth), np.zeros(2)) for k in range(3))
    other = [folds[1].to_bytes(), folds[0].to_bytes()]

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [ToxicityModel.from_bytes(m) for m in other]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fold, rows = part.column(2).to_numpy(), part.column(0).to_pylist()
                x = np.where(fold == 0, *(m.difference(rows) for m in models))
                yield pa.RecordBatch.from_arrays([pa.array(x), part.column(1)], ["x", "toxic"])

    pairs = sample.select("text", "toxic", "fold").mapInArrow(held_out, "x double, toxic int").toPandas().sort_values(["x", "toxic"])  # the sample's rows
    y = pairs.toxic.to_numpy(float)
    weight = np.where(y == 1, totals[1] / seen[1], totals[0] / seen[0])
    w = logistic.fit(_bend(pairs.x.to_numpy()), y, weight, np.full(2, 1e-3))
    whole.weights = w if w[0] > 0 else np.array([0.0, np.log(share / (1 - share))])
    return whole.to_bytes()


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, batch_rows: int = 256) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are not read.
    ``labels`` has doc_id and toxic (several labels of an id: toxic if most say so).
    Null and empty texts have no evidence and score as such a text calibrates; a null
    doc_id is never held out and has no label. Without labelled texts of both classes the
    score is the toxic share of the labels, shrunk toward one half: one half without any. Repeated rows are scored each. Of an empty
    table the result is empty. Other columns of ``docs`` are not read.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    labels = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    model = _fit(rows.select("doc_id", "text"), labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = ToxicityModel.from_bytes(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_rows):
                part = batch.slice(lo, batch_rows)
                score = pa.array(fitted.score(part.column(2).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), score], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
