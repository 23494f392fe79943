"""Quality classifier by positive-unlabelled learning.

A linear model on statistics of the whole text minimises the non-negative unbiased risk: trusted
positives count with the class prior, and unlabelled web text stands for the mixture of both classes.
When the estimated risk of negatives falls below zero, the step undoes it instead of following it.  The
prior is estimated from the same two samples; labels of negatives are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, small_batches
from .features import STATS, stats
from .labelled import about, held_out, labelled_texts, read_labels

#: Rows that the model is fitted on, at most about: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 20_000, 20_000
THRESHOLD = 0.7


class Model:
    """Standardised statistics, their squares and a constant, weighed; its score is a logistic function."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, values: np.ndarray) -> np.ndarray:
        z = np.clip((values - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6, np.ones((len(z), 1))], axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        return _logistic(self.inputs(values) @ self.weights)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risks(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The logistic risk of positives, and of negatives as the unlabelled texts less their positive part, which may fall below zero."""
    zp, zu = model.inputs(positive) @ model.weights, model.inputs(unlabelled) @ model.weights
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled texts, from positives and unlabelled texts alone.

    A classifier of one against the other is learned on every other row of both and ranks the rest.  Above
    any score the positives' part of the unlabelled texts is the prior times the positives' part; where
    hardly a negative is left the ratio of the two parts is the prior.  The score is chosen at which that
    ratio's upper confidence bound is least.  Without either sample: one half.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    out = []
    for half in (0, 1):
        model = fit(positive[half::2], unlabelled[half::2], 0.5, steps=400, balanced=True)
        p, u = np.sort(model.score(positive[1 - half :: 2])), np.sort(model.score(unlabelled[1 - half :: 2]))
        share_p = 1 - np.searchsorted(p, p) / len(p)
        share_u = 1 - np.searchsorted(u, p) / len(u)
        slack = np.sqrt(np.log(4 / delta) / 2 / len(p)) + np.sqrt(np.log(4 / delta) / 2 / len(u))
        best = np.argmin((share_u + (1 + gamma) * slack) / share_p)
        out.append(share_u[best] / share_p[best])
    return float(min(0.98, max(0.02, np.mean(out))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4, balanced: bool = False) -> Model:
    """Adam on the non-negative risk with the logistic loss.  Without positives or unlabelled texts the score is the prior.

    balanced: unlabelled texts count as negatives, each sample as one half.
    """
    every = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        weights = np.zeros(2 * STATS + 1)
        weights[-1] = np.log(prior / (1 - prior))
        return Model(np.zeros(STATS), np.ones(STATS), weights)
    model = Model(every.mean(0), every.std(0) + 1e-6, np.zeros(2 * STATS + 1))
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w = model.weights
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        if balanced:
            step = (_logistic(zu) @ u) / len(u) - (_logistic(-zp) @ p) / len(p) + decay * w
        of_positives = -prior * (_logistic(-zp) @ p) / len(p)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negatives = (_logistic(zu) @ u) / len(u) - prior * (_logistic(zp) @ p) / len(p)
        if not balanced:
            step = (of_positives + of_negatives if negative_risk >= 0 else -of_negatives) + decay * w
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step * step
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return model


def _values(texts) -> np.ndarray:
    return np.concatenate([np.zeros((0, STATS)), *[stats(part) for _, _, part in blocks(texts)]])


def statistics(text: Column) -> Column:
    """The statistics of a text column as an array; null and empty texts have zeros."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_values(texts)), dtype=object)

    return run(text)


def _collected(values: DataFrame) -> np.ndarray:
    rows = values.select("text").toPandas()["text"]
    return np.array(rows.tolist()) if len(rows) else np.zeros((0, STATS))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on trusted positives (y = 1 in labels) and texts of docs whatever their labels.

    Only about POSITIVES + UNLABELLED rows of statistics reach the driver.
    """
    docs = small_batches(docs)
    positive = _collected(labelled_texts(docs, labels.where("y = 1"), POSITIVES, of=statistics))
    unlabelled = _collected(about(docs.select("doc_id", "text"), "doc_id", UNLABELLED, salt=2, of=statistics))
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(text: Column, model: Model) -> Column:
    """Quality of a text column from 0 to 1, higher where a trusted text is likelier; null and empty texts have one too."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_values(texts)))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated rows and null ids included."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), read_labels(spark, sf_dir, "quality"))
