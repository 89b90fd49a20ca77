"""Quality classification with hierarchical empirical Bayes.

A document's evidence comes from a logistic model over features of its whole text,
fitted on a bounded sample of labelled rows. Hosts and the paths under them have
quality rates of their own: the documents' labels, or the model's probabilities where
there is no label, are summed by path and host, and each level's posterior mean shrinks
toward the level above,

    rate(host) = (good(host) + m1 * rate(all)) / (n(host) + m1)
    rate(path) = (good(path) + m2 * rate(host)) / (n(path) + m2),

each without the document that is scored, so its own label never enters its score, with
strengths m1, m2 set from the spread between the groups by the method of moments;
sparse sites thus stay near the global rate. A document's score is its evidence moved by
its path's log-odds against the global ones.

All counts cover all documents and are sums combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm import logistic
from satchel.llm.common import WORD, materialise, spare_name

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Documents with a lower score are rejected.
THRESHOLD = 0.5
#: Bounds of the shrinkage strengths.
STRENGTHS = (20.0, 10_000.0)


def features(text: Column) -> list[Column]:
    """What the model looks at: shares of kinds of characters, words and lines of the whole text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.greatest(count(WORD), F.lit(1.0))
    lines = F.split(text, "\n")
    upper, marks = count(r"\p{Lu}") / chars, count(r"[^\p{L}\p{N}\s]") / chars
    loose = count(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\s]+(?![^\x20\x09-\x0D])") / words
    twice = count(r"([^\p{L}\p{N}\s])\1") / words
    digits = count(r"\p{N}") / chars
    repeated = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    shouted = count(r"\p{Lu}{2,}") / words
    return [F.log1p(words), chars / words, upper, marks, loose, twice, digits, repeated, shouted]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    return logistic.fit(x, y, np.ones(len(y)), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _model(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[list[float], list[float], list[float]]:
    """(centre, scale, weights) from the sample: the labelled ids with the smallest hashes; rows that share an id count as one, by the mean of their features, so no more than ``sample_rows`` rows reach the driver."""
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = [f.alias(f"f{i}") for i, f in enumerate(features(F.col("text")))]
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "good", *found)
    rows = rows.groupBy("doc_id", "good").agg(*(F.avg(f"f{i}").alias(f"f{i}") for i in range(len(found)))).drop("doc_id")
    table = np.array(rows.toPandas(), dtype=float).reshape(-1, 1 + len(features(F.lit(""))))
    y, x = table[:, 0], table[:, 1:]
    if not len(y):
        return [0.0] * x.shape[1], [1.0] * x.shape[1], [0.0] * (2 * x.shape[1]) + [0.0]
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - centre) / scale, -6, 6)
    return centre.tolist(), scale.tolist(), fit_logistic(np.hstack([z, z * z]), y).tolist()


def classify_quality(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, kept for each row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1; several labels of an id are averaged).
    Null texts count as empty; null hosts and paths are groups of their own. Without
    labels every document has evidence 0.5 and is kept. Repeated rows are scored each.
    Of an empty table the result is empty. Columns of ``docs`` other than doc_id, text
    and the two named are not read.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("good"))
    rows = docs.select("doc_id", "text", F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    centre, scale, weights = _model(rows, labels, sample_rows)
    z = F.array(*(F.least(F.greatest((f - c) / s, F.lit(-6.0)), F.lit(6.0)) for f, c, s in zip(features(F.col("text")), centre, scale, strict=True)))
    k = len(centre)
    dot = sum((F.col("z")[i] * weights[i] + F.col("z")[i] * F.col("z")[i] * weights[k + i] for i in range(k)), F.lit(weights[-1]))
    scored = rows.select("doc_id", "host", "path", z.alias("z")).select("doc_id", "host", "path", (1 / (1 + F.exp(-dot))).alias("evidence"))
    scored = materialise(scored.join(labels, "doc_id", "left"), "evidence")
    good = F.coalesce("good", "evidence")
    paths = materialise(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    base = paths.agg((F.sum("good") / F.sum("n")).alias("rate"))
    base_rate = base.head()[0]
    base_rate = 0.5 if base_rate is None else base_rate

    def strength(groups: DataFrame, mean: Column) -> float:
        """m such that a Beta prior with m pseudo-counts has the spread seen between groups."""
        noise = mean * (1 - mean) / F.col("n")
        found = groups.agg(F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2) - F.sum(F.col("n") * noise), F.sum("n"), F.avg(mean * (1 - mean))).head()
        spread = (found[0] or 0.0) / (found[1] or 1)
        return float(np.clip((found[2] or 0.25) / spread - 1 if spread > 0 else STRENGTHS[1], *STRENGTHS))

    m1 = strength(hosts, F.lit(base_rate))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    nested = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "nested-counts")
    rate = lambda good, n, m, above: (good + m * above) / (n + m)
    m2 = strength(nested, rate(F.col("host_good"), F.col("host_n"), m1, F.lit(base_rate)))
    counts = nested.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_n", "host_good", F.col("n").alias("path_n"), F.col("good").alias("path_good"))
    joined = scored.join(counts, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    own = F.coalesce("good", "evidence")
    joined = joined.withColumn("host_rate", rate(F.greatest(F.col("host_good") - own, F.lit(0.0)), F.col("host_n") - 1, m1, F.lit(base_rate)))
    joined = joined.withColumn("path_rate", rate(F.greatest(F.col("path_good") - own, F.lit(0.0)), F.col("path_n") - 1, m2, F.col("host_rate")))
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(F.col("path_rate")) - _logit(F.lit(base_rate)))))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score")).withColumn("kept", F.col("score") >= threshold)


def reject_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps.

    Rows of one doc_id with different texts may differ in their scores; the id stays if
    any of them is kept.
    """
    mark = f"{spare_name(docs)}kept"
    kept = classify_quality(docs, labels, **options).where("kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
