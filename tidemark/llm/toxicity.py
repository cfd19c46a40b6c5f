"""Toxicity as ordinal severity: cumulative-link regression over sparse text features.

Grades 0..K-1 follow P(grade <= k) = sigmoid(theta_k - w.x): the thresholds are ordered, and all of them share the
weights w. Features are the distinct words of a text and their beginnings, hashed. The model is fitted on the driver over a bounded
sample of labelled documents; features that do not set the grades apart at a fixed significance keep weight 0.
Scoring is one pass over all documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, WordHash, bound_batches, fresh, read, released
from .decontaminate import words

#: Hashed features.
FEATURES = 1 << 20
#: Bytes of a word's beginning that are features beside the word itself: stems, where endings vary.
PREFIXES = (4, 5, 6)
#: Labelled documents to fit on, drawn by the hash of their id.
SAMPLE = 8000
#: Documents that must hold a feature, and the z-score its share among higher grades must reach.
MIN_DOCS, MIN_Z = 3, 4.0


@dataclass(frozen=True)
class Severity:
    """A fitted model: the features with a weight, their weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, a row for each score."""
        z = np.clip(self.thresholds[None, :] - score[:, None], -500, 500)
        return 1 - 1 / (1 + np.exp(-z))


def _hashed(its: list[bytes], hashes: WordHash) -> np.ndarray:
    kinds = set(its)
    kinds |= {b"^" + w[:k] for w in kinds for k in PREFIXES if len(w) >= k}
    return np.unique(hashes.of(list(kinds)) & np.uint64(FEATURES - 1)).astype(np.int64)


class _Weighted(dict):
    """The features of a word that have a weight; for most words there are none."""

    def __init__(self, features: np.ndarray):
        super().__init__()
        self.known, self.hashes = set(features.tolist()), WordHash()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = out = tuple(f for f in _hashed([word], self.hashes).tolist() if f in self.known)
        return out

    def of(self, its: list[bytes]) -> list[int]:
        return sorted({f for w in set(its) for f in self[w]})


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood; (rows, cols) are the features present.

    Grades that no row has get a threshold at the border of the next one.
    """
    k = int(grades.max()) + 1 if len(grades) else 1
    if k < 2:
        return np.zeros(n_features), np.full(1, 30.0)
    n = len(grades)
    share = np.array([(np.sum(grades <= j) + 0.5) / (n + 1.0) for j in range(k - 1)])
    first = np.log(share / (1 - share))
    par = np.concatenate((np.zeros(n_features), [first[0]], np.log(np.maximum(np.diff(first), 1e-3))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        w, gaps = par[:n_features], np.exp(np.clip(par[n_features + 1 :], -12, 12))
        theta = par[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(rows, weights=w[cols], minlength=n)
        above, below = np.append(theta, np.inf)[grades], np.concatenate(([-np.inf], theta))[grades]
        up = np.where(np.isinf(above), 1.0, sig(above - score))
        lo = np.where(np.isinf(below), 0.0, sig(below - score))
        p = np.maximum(up - lo, 1e-12)
        d_up, d_lo = up * (1 - up) / p, lo * (1 - lo) / p
        d_score = d_up - d_lo  # of -log p
        grad_theta = np.array([d_lo[grades == j + 1].sum() - d_up[grades == j].sum() for j in range(k - 1)])
        grad = np.concatenate((np.bincount(cols, weights=d_score[rows], minlength=n_features) / n + l2 * w, [grad_theta.sum() / n], [grad_theta[j:].sum() * gaps[j - 1] / n for j in range(1, k - 1)]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        par = par - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(par[n_features + 1 :], -12, 12))
    return par[:n_features], par[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))


def fit_severity(docs: DataFrame, labels: DataFrame, grade: str = "case when toxic = 0 then 0 when quality = 0 then 2 else 1 end", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Severity:
    """A model of the grade (an expression over labels) fitted on at most ``sample`` labelled ids.

    Labels with a null id or grade and documents without text are left out; an id with several labels has the
    highest. An id that several documents have counts once, with the text that comes first in order; so the rows are
    bounded by ``sample`` however often ids repeat. Without labels of two grades the model has no weights and calls
    nothing severe. Further columns of either table are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    drawn = labels.select(F.col(id_col).alias("id"), F.expr(grade).cast("int").alias("grade")).dropna().groupBy("id").agg(F.max("grade").alias("grade"))
    drawn = scratch.cut(drawn.orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    picked = texts.join(F.broadcast(drawn), "id")  # at most `sample` short rows
    picked = picked.groupBy("id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            made = [_hashed(words(t.as_py()), hashes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["grade", "x"])

    x = scratch.cut(picked.mapInArrow(released(features), "grade int, x array<long>").withColumn("row", F.monotonically_increasing_id()))
    totals = {r.grade: r.n for r in x.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n, high = sum(totals.values()), sum(v for k, v in totals.items() if k > 0)
    if not 0 < high < n:
        return Severity(np.zeros(0, np.int64), np.zeros(0), np.full(1, 30.0))
    rate = high / n
    cells = x.select(F.explode("x").alias("f"), (F.col("grade") > 0).cast("int").alias("hi")).groupBy("f").agg(F.count("*").alias("n"), F.sum("hi").alias("k"))
    z = (F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    chosen = np.sort(np.array([r.f for r in cells.filter((F.col("n") >= MIN_DOCS) & (F.abs(z) >= MIN_Z)).select("f").collect()], np.int64))  # at most FEATURES
    keep = spark.sparkContext.broadcast(chosen)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.intersect1d(v.values.to_numpy(), keep.value, assume_unique=True) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64())), batch.column(2)], names=["grade", "x", "row"])

    data = x.mapInArrow(released(only), x.schema).orderBy("row").collect()  # at most `sample` rows
    grades = np.array([r.grade for r in data])
    rows = np.repeat(np.arange(len(data)), [len(r.x) for r in data])
    cols = np.searchsorted(chosen, np.array([f for r in data for f in r.x], np.int64))
    weights, thresholds = fit_ordinal(rows, cols, grades, len(chosen))
    return Severity(chosen, weights, thresholds)


def score_severity(docs: DataFrame, model: Severity, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of docs with expected severity and P(grade >= 1), and the names of the two added columns.

    Null and empty texts have no features and so no evidence; they get the severity of the bare thresholds. The result
    depends on the text alone, so rows that repeat get equal results. Other columns pass through as they are.
    """
    bound_batches(docs.sparkSession)
    names = fresh(docs, "severity", "p_toxic")
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.zeros(FEATURES)
        table[m.features] = m.weights
        weighted = _Weighted(m.features)
        for batch in batches:
            score = np.array([table[weighted.of(words(t.as_py()))].sum() if t.is_valid else 0.0 for t in batch.column(at)])
            p = m.at_least(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0])], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(released(run), schema), names


def without_toxic(docs: DataFrame, model: Severity, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose P(grade >= 1) stays below ``limit``, in the same columns; at the limit itself they go."""
    scored, (_, p) = score_severity(docs, model, text_col)
    return scored.filter(F.col(p) < limit).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every whole text, and whether the pipeline rejects it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_severity(docs, read(spark, sf_dir, "labels"))
    scored, (severity, p) = score_severity(docs, model)
    return scored.select("doc_id", F.round(severity, 6).alias("severity"), F.round(p, 6).alias("p_toxic"), (F.col(p) >= 0.5).alias("toxic"))
