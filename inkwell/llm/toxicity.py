"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = logistic(threshold_k - w.x): one weight for each feature, shared by all ordered
thresholds. A feature is a word or a word's beginning; x counts the distinct words of the whole
text that have it. Fitted on a bounded sample of
labelled documents, applied to all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hold, materialise, small_batches, with_ids

#: Labelled documents the model is fitted on at most, those of the smallest hashes; features it has weights for at most.
SAMPLE = 20_000
FEATURES = 2_000
#: Lengths of the beginnings that are features.
PREFIXES = range(3, 10)
#: Documents of the sample a feature must be in, and standard deviations its share of harmful ones must be off.
LEAST_DOCS = 4
LEAST_DEVIATION = 3.0
REJECT = 0.5
RIDGE = 3e-5
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Weights by word and ascending thresholds; grades are 0..len(thresholds)."""

    weights: dict[str, float]
    thresholds: np.ndarray
    kept: dict[str, float] = field(default_factory=dict)

    def word(self, w: str, most: int = 100_000) -> float:
        own = sum(self.weights.get(f, 0.0) for f in features_of(w))
        if len(self.kept) >= most:
            self.kept.clear()
        self.kept[w] = own
        return own

    def latent(self, text: str | None) -> float:
        get, word, total = self.kept.get, self.word, 0.0
        for w in words(text):
            own = get(w)
            total += word(w) if own is None else own
        return total

    def chances(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -500, 500)))


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word itself and, marked, its beginnings."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def fit_ordinal(row: np.ndarray, col: np.ndarray, x: np.ndarray, grade: np.ndarray, features: int, ridge: float = RIDGE, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model for a sparse matrix of x at (row, col); by
    gradient steps of adaptive size on the mean log-likelihood, with a ridge penalty."""
    n, k = len(grade), int(grade.max())
    share = np.clip(np.array([(grade < j).mean() for j in range(1, k + 1)]), 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    # Thresholds stay ascending: the first, then logs of the gaps.
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        gaps = np.exp(p[features + 1 :])
        theta = p[features] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(row, weights=p[col] * x, minlength=n) if len(row) else np.zeros(n)
        cum = 1 / (1 + np.exp(np.clip(eta[:, None] - theta[None, :], -500, 500)))  # P(grade <= j - 1)
        edge = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
        high, low = edge[np.arange(n), grade + 1], edge[np.arange(n), grade]
        chance = np.maximum(high - low, 1e-12)
        slope = edge * (1 - edge)
        d_high, d_low = slope[np.arange(n), grade + 1] / chance, slope[np.arange(n), grade] / chance
        g_eta = (d_high - d_low) / n
        g_theta = np.zeros(k)
        np.add.at(g_theta, grade[grade < k], -d_high[grade < k] / n)
        np.add.at(g_theta, grade[grade > 0] - 1, d_low[grade > 0] / n)
        g = np.zeros_like(p)
        g[:features] = (np.bincount(col, weights=g_eta[row] * x, minlength=features) if len(row) else 0) + ridge * p[:features]
        g[features] = g_theta.sum()
        g[features + 1 :] = np.cumsum(g_theta[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(p[features + 1 :])
    return p[:features], p[features] + np.concatenate([[0], np.cumsum(gaps)])


def severity_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a poor one: a stand-in, as the
    labels grade no severity; fit() takes grades of any other source. Labels without toxicity are left out; of repeated ones the gravest counts; a null quality is a good one."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """The model for docs (doc_id, text) with grades (doc_id, grade), ascending from 0.

    Ids are integers. Labels of documents that docs lacks are left out. With one grade or none in the sample nothing is told apart: every document has that grade.
    """
    small_batches(docs.sparkSession)
    # Only labels of documents there are count for the sample, which is bounded, so it is sent to the documents.
    there = with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id")), grades, "doc_id").distinct()
    drawn = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    labelled = materialise(labelled.select("grade", "text"), "toxicity-sample")
    total, harmful, top = labelled.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)), F.coalesce(F.max("grade"), F.lit(0))).first()
    if harmful in (0, total):
        return Model({}, np.full(top, -1e9))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        n, bad = Counter(), Counter()  # a task's part of the bounded sample
        for batch in batches:
            for grade, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {f for w in words(text.as_py()) for f in features_of(w)}
                n.update(own)
                if grade:
                    bad.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64()), pa.array([bad[f] for f in n], pa.int64())], ["feature", "n", "bad"])

    p = harmful / total
    by_word = labelled.mapInArrow(counted, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    off = F.abs(F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    picked = by_word.where(F.col("n") >= LEAST_DOCS).withColumn("off", off).where(F.col("off") >= LEAST_DEVIATION).orderBy(F.desc("off"), "feature").limit(features)
    vocabulary = sorted(r.feature for r in picked.collect())
    place = {w: i for i, w in enumerate(vocabulary)}

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Counter(place[f] for w in words(t.as_py()) for f in features_of(w) if f in place) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[*c] for c in own], pa.list_(pa.int32())), pa.array([[*c.values()] for c in own], pa.list_(pa.int32()))], ["grade", "col", "x"])

    # Of the sample only grades and places of picked features come to the driver; the bounded vocabulary goes to the rows.
    rows = labelled.mapInArrow(placed, "grade int, col array<int>, x array<int>").toArrow()
    discard(labelled)
    lists, x = rows.column("col").to_pylist(), rows.column("x").to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    col = np.array([i for v in lists for i in v], dtype=np.int64)
    value = np.array([n for v in x for n in v], dtype=np.float64)
    weights, thresholds = fit_ordinal(row, col, value, rows.column("grade").to_numpy().astype(np.int64), len(vocabulary))
    return Model(dict(zip(vocabulary, weights.tolist(), strict=True)), thresholds)


def score(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """docs with severity (the expected grade), grade (the likeliest), p_toxic and toxic (p_toxic >= reject).

    A null text is an empty one, scored like any; a column of one of these names is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("severity", "grade", "p_toxic", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        own = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            over = own.chances(np.array([own.latent(texts[i].as_py()) for i in range(len(texts))], dtype=np.float64))
            each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1), axis=1)
            p = over[:, 0] if over.shape[1] else np.zeros(len(over))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(over.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p), pa.array(p >= reject)], [*batch.schema.names, "severity", "grade", "p_toxic", "toxic"])

    schema = docs.withColumns({"severity": F.lit(0.0), "grade": F.lit(0), "p_toxic": F.lit(0.0), "toxic": F.lit(True)}).schema
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of docs by a model fitted on those of them that labels cover."""
    return score(docs, fit(docs, severity_grades(labels)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
