"""Severity grades by cumulative-link ordinal regression.

``P(grade <= k) = logistic(threshold_k - w . x)``: one weight vector shared by all
ordered thresholds. ``x`` marks which words and word beginnings a text has. The
fit runs on the driver over a bounded sample of labelled rows (``PER_GRADE`` for
each grade, chosen by hash); each row stands for as many of its grade as there are
over those sampled, so that a probability means the same at every size. Features are
screened by a two-sample test on that sample, so the model is bounded by
``MAX_FEATURES`` as well. Scoring reads every
whole text and never shuffles.

Defined results. A null or empty text has no features and gets the grade of the
thresholds alone. Rows with a null label or id are not learned from; of several
labels of a document each counts. Without labels, or with one grade only, every
document gets that grade (0 without any), as certain. Repeated ids give a row each;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import pieces, thrifty

#: Labelled rows of each grade that the fit reads at most; features kept at most; share of the sample that a feature must be in (five documents at least).
PER_GRADE, MAX_FEATURES, MIN_SHARE = 3_000, 20_000, 0.003
#: Standard errors by which a feature's share must differ between the grades; strength of the penalty; steps of the fit.
SCREEN, PENALTY, STEPS = 4.5, 1e-4, 600
#: Lengths of the word beginnings used as features.
BEGINNINGS = (5, 6)
#: Words whose features a task remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    grades: list[int]
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: dict[str, float] = field(default_factory=dict)

    def probabilities(self, score: float) -> np.ndarray:
        """Of each grade, of a text with this sum of weights."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - score, -500, 500)))
        return np.diff(below, prepend=0.0, append=1.0)


def fit(samples: list[tuple[int, list[str]]], stands_for: dict[int, float] | None = None) -> Model:
    """Grades and feature lists -> model. ``stands_for``: how many labelled rows a
    sampled one of each grade stands for; without it, one."""
    grades = sorted({g for g, _ in samples})
    if len(grades) < 2:
        return Model(grades or [0])
    y = np.array([grades.index(g) for g, _ in samples])
    counts = [Counter(), Counter()]
    for k, (_, names) in zip(y, samples, strict=True):
        counts[int(k > 0)].update(names)
    n0, n1 = (y == 0).sum(), (y > 0).sum()

    def distance(name: str) -> float:
        a, b = counts[0][name], counts[1][name]
        p = (a + b + 1) / (n0 + n1 + 2)
        return abs(b / n1 - a / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))

    found = [(distance(f), f) for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= max(5, MIN_SHARE * len(samples))]
    kept = [f for d, f in sorted(found, reverse=True)[:MAX_FEATURES] if d >= SCREEN]
    at = {f: k for k, f in enumerate(kept)}
    rows = np.array([k for k, (_, names) in enumerate(samples) for f in names if f in at], dtype=np.int64)
    cols = np.array([at[f] for _, names in samples for f in names if f in at], dtype=np.int64)
    n, m, last = len(samples), len(kept), len(grades) - 1
    taken = np.bincount(y, minlength=last + 1)
    true = taken * np.array([(stands_for or {}).get(g, 1.0) for g in grades])
    weight = (true / taken)[y] / true.sum()
    w = np.zeros(m)
    share = np.cumsum(true)[:-1] / true.sum()
    theta = np.log(share / (1 - share))  # what the grades' shares alone give
    gaps = np.concatenate([theta[:1], np.log(np.diff(theta))]) if last > 1 else theta.copy()  # first threshold, then logs of the distances: always ordered
    state = [np.zeros(m), np.zeros(m), np.zeros(last), np.zeros(last)]
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        score = np.bincount(rows, w[cols], minlength=n)
        low, high = (1 / (1 + np.exp(-np.clip(bounds[y + k] - score, -500, 500))) for k in (0, 1))
        p = np.maximum(high - low, 1e-12)
        d_score = weight * (1 - high - low)  # of the loss
        d_high, d_low = -weight * high * (1 - high) / p, weight * low * (1 - low) / p
        d_theta = np.bincount(np.minimum(y, last - 1), np.where(y < last, d_high, 0), minlength=last) + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, d_low, 0), minlength=last)
        tail = np.cumsum(d_theta[::-1])[::-1]
        d_gaps = np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])
        d_w = np.bincount(cols, d_score[rows], minlength=m) + PENALTY * w
        for value, slope, (m1, m2) in ((w, d_w, state[:2]), (gaps, d_gaps, state[2:])):  # Adam
            m1 *= 0.9
            m1 += 0.1 * slope
            m2 *= 0.99
            m2 += 0.01 * slope**2
            value -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
    return Model(grades, theta, {f: float(w[k]) for f, k in at.items() if w[k]})


def sample(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> list[tuple[int, list[str]]]:
    """Up to ``per_grade`` labelled documents of each grade, those of the smallest hashes."""
    graded = labels.select(F.col(id_col).alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    chosen = None
    for (g,) in graded.select("grade").distinct().orderBy("grade").collect():
        some = graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return []

    def names(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [sorted({f for w in words_of(x.as_py() or "") for f in features_of(w)}) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.string()))], ["grade", "names"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(thrifty(names), "grade int, names array<string>")
    return [(r.grade, r.names) for r in found.toLocalIterator()]


def learned(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> Model:
    """The model of a bounded sample, weighted by how many labelled documents each grade has."""
    graded = labels.select(F.col(id_col).alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    stands_for = {r.grade: max(1.0, r.n / per_grade) for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    return fit(sample(docs, labels, grade, id_col, text_col, per_grade), stands_for)


class Judge:
    """Grades of texts under a model; the features of words already met are remembered."""

    def __init__(self, model: Model):
        self.model, self.values, self.known = model, np.array(model.grades), {}

    def __call__(self, text: str) -> tuple[float, int, float, bool]:
        weights, found = self.model.weights, set()
        for word in words_of(text):
            names = self.known.get(word)
            if names is None:
                names = tuple(f for f in features_of(word) if f in weights)
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[word] = names
            if names:
                found.update(names)
        p = self.model.probabilities(sum(weights[f] for f in sorted(found)))
        high = float(p[1:].sum()) if self.values[0] <= 0 else 1.0
        return round(float(p @ self.values), 6), int(self.values[p.argmax()]), round(high, 6), high >= 0.5


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``expected_severity``, ``grade`` (the
    likeliest), ``p_toxic`` (above the lowest grade), ``toxic``."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for part in pieces(parts, 1):
            cols = list(zip(*(judge(x.as_py() or "") for x in part.column(1)), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(thrifty(run), f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for part in pieces(parts, at):
            yield part.filter(pa.array([not judge(x.as_py() or "")[3] for x in part.column(at)], pa.bool_()))

    return docs.mapInArrow(thrifty(run), docs.schema)


def severity() -> Column:
    """Grades of the ``labels`` table: 0 not toxic, 1 toxic, 2 toxic and of poor quality."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
