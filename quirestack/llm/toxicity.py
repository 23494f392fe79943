"""Toxicity by weak supervision.

Voters are lexicon terms (words and word beginnings that the labelled rows single out) and patterns.
Each fires or stays silent on a text.  A generative model of two classes learns, without labels, how
often each voter fires in either class; voters that fire together beyond what their class explains
share one vote.  Its posterior labels train a linear classifier over more terms, which scores texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, documents, small_batches
from .features import ASTERISKS, CAPITALS, EXCLAMATIONS, REPEATED_LINES, REPEATED_WORDS, levels, stats, terms
from .labelled import held_out, labelled_texts, read_labels

#: Labelled rows that voters and classifier are learned from, at most about.
LABELLED = 20_000
#: Levels of terms with weights of their own, and those of them that vote, at most.
TERMS, VOTERS = 4096, 768
#: Different words that a term must follow in toxic texts, in all and for each toxic text that holds the
#: term, and the share of its texts that is labelled toxic, to count and to vote.
LEAST_CONTEXTS, CONTEXTS_A_TEXT, COUNTS_FROM, VOTES_FROM = 6, 0.05, 0.5, 0.75
THRESHOLD = 0.3
#: Values of features.stats that patterns look at: the shares of '!', '*' and capitals, repeated words, repeated lines.
PATTERNS = ((EXCLAMATIONS, 0.5), (ASTERISKS, 0.5), (CAPITALS, 1.5), (REPEATED_WORDS, 1.0), (REPEATED_LINES, 1.0))


def _fires(texts: list[bytes], bases: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, position in known) of the known features in each text, once each; bases: the terms they come from; both are sorted."""
    owner, found, _, words = terms(texts)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = bases[np.minimum(np.searchsorted(bases, found), len(bases) - 1)] == found
    text, feature, _ = levels(owner[hit], found[hit], words)
    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    hit = known[at] == feature
    order = np.lexsort((at[hit], text[hit]))
    return text[hit][order], at[hit][order]


def _patterns(texts: list[bytes]) -> np.ndarray:
    values = stats(texts)
    return np.stack([values[:, i] > limit for i, limit in PATTERNS], axis=1)


def term_counts(sample: DataFrame) -> DataFrame:
    """(feature, term, toxic, clean): in how many toxic and other texts of (text, y) each level of a term is found."""

    def run(frames):
        for frame in frames:
            labels = frame["y"].to_numpy()
            for begin, _, part in blocks(frame["text"]):
                owner, found, _, words = terms(part)
                text, feature, term = levels(owner, found, words)
                kind, first, which = np.unique(feature, return_index=True, return_inverse=True)
                toxic = np.bincount(which, weights=labels[begin + text], minlength=len(kind)).astype(np.int64)
                yield pd.DataFrame({"feature": kind, "term": term[first], "toxic": toxic, "clean": np.bincount(which, minlength=len(kind)) - toxic})

    counts = sample.mapInPandas(run, "feature long, term long, toxic long, clean long")
    return counts.groupBy("feature", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def contexts(sample: DataFrame) -> DataFrame:
    """(term, contexts): after how many different words each term stands in the toxic texts of (text, y).

    Copies of one text repeat its contexts, so they lend its words no weight.
    """

    def run(frames):
        for frame in frames:
            for _, _, part in blocks(frame["text"]):
                _, found, before, _ = terms(part)
                pairs = np.unique(np.stack([found, before]), axis=1)
                yield pd.DataFrame({"term": pairs[0], "before": pairs[1]})

    pairs = sample.where("y = 1").select("text").mapInPandas(run, "term long, before long")
    return pairs.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("contexts"))


def _correlations(x: np.ndarray, classes: list[tuple[np.ndarray, np.ndarray]], strong: float = 0.5) -> np.ndarray:
    """Correlations of voters within classes (row weights, firing rates), where they are at least strong; a voter has none with itself."""
    cov = sum(((x * w[:, None].astype(np.float32)).T @ x).astype(np.float64) - max(w.sum(), 1e-9) * np.outer(p, p) for w, p in classes)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.clip(cov / np.outer(scale, scale), 0, 1)
    np.fill_diagonal(corr, 0)
    corr[corr < strong] = 0
    return corr


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class for each row of a boolean matrix (texts by voters), by expectation-maximisation.

    Accuracies are the voters' firing rates in either class.  A voter's evidence is divided by
    the root of one plus its strong correlations with other voters within the classes, so a group of
    voters that say the same counts as its root.
    """
    x = votes.astype(np.float32)
    n, m = x.shape
    if not n or not m:
        return np.full(n, prior)
    # To begin with, voters that fire on nearly the same texts count as one, and a second vote decides.
    together = _correlations(x, [(np.ones(n), x.mean(0))], strong=0.8)
    post = 1 / (1 + np.exp(-4 * (x @ (1 / (1 + together.sum(1))) - 1.5)))
    share = 1 / np.sqrt(1 + together.sum(1))
    for step in range(rounds):
        weight = post.sum()
        p1 = np.clip((post @ x + 0.5) / (weight + 1), 1e-4, 1 - 1e-4)
        p0 = np.clip(((1 - post) @ x + 0.5) / (n - weight + 1), 1e-4, 1 - 1e-4)
        if step in (3, 10):
            share = 1 / np.sqrt(1 + _correlations(x, [(post, p1), (1 - post, p0)]).sum(1))
        on, off = np.log(p1 / p0) * share, np.log((1 - p1) / (1 - p0)) * share
        z = np.log(prior / (1 - prior)) + off.sum() + x @ (on - off)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, m: int, dense: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4):
    """Logistic regression on a sparse 0/1 matrix (n by m) and dense columns, with soft targets: weights, dense weights, constant."""
    w, d, c = np.zeros(m), np.zeros(dense.shape[1]), -2.0
    size = m + dense.shape[1] + 1
    first, second = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns], minlength=n) + dense @ d + c
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(n, 1)
        step = np.concatenate([np.bincount(columns, weights=error[rows], minlength=m) + decay * w, dense.T @ error + decay * d, [error.sum()]])
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step * step
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, d, c = w - move[:m], d - move[m:-1], c - move[-1]
    return w, d, c


class Model:
    def __init__(self, bases: np.ndarray, known: np.ndarray, weights: np.ndarray, patterns: np.ndarray, constant: float):
        self.bases, self.known, self.weights, self.patterns, self.constant = bases, known, weights, patterns, constant

    def score(self, texts: list[bytes]) -> np.ndarray:
        text, term = _fires(texts, self.bases, self.known)
        z = np.bincount(text, weights=self.weights[term], minlength=len(texts)) + _patterns(texts) @ self.patterns + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most about LABELLED rows; TERMS terms and the sample's votes reach the driver.

    Without labels, or without toxic ones, no term counts and every score is small.
    """
    sample = labelled_texts(small_batches(docs), labels, LABELLED, salt=3).persist()
    prior = min(0.9, max(0.005, sample.agg(F.avg("y").alias("p")).first()["p"] or 0.0))
    # Every level of a term is judged by the texts of its first, which holds all of them.
    least = F.greatest(F.lit(float(LEAST_CONTEXTS)), CONTEXTS_A_TEXT * F.max("toxic").over(Window.partitionBy("term")))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    chosen = (
        term_counts(sample)
        .withColumn("least", least)
        .where(share >= COUNTS_FROM)
        .join(contexts(sample).where(F.col("contexts") >= LEAST_CONTEXTS), "term")
        .where("contexts >= least")
        .orderBy(F.desc(F.col("toxic") * share * share), "feature")
        .limit(TERMS)
        .select("feature", "term", share.alias("share"))
        .toPandas()
    )
    voting = chosen[chosen["share"] >= VOTES_FROM]["feature"].to_numpy()[:VOTERS]
    known = np.sort(chosen["feature"].to_numpy(np.int64))
    bases = np.unique(chosen["term"].to_numpy(np.int64))

    @F.pandas_udf("found array<int>, patterns array<boolean>")
    def votes(texts: pd.Series) -> pd.DataFrame:
        found, patterns = [], []
        for _, _, part in blocks(texts):
            text, term = _fires(part, bases, known)
            found += np.split(term.astype(np.int32), np.searchsorted(text, np.arange(1, len(part))))
            patterns += list(_patterns(part))
        return pd.DataFrame({"found": found, "patterns": patterns})

    seen = sample.select(votes("text").alias("v")).select("v.*").toPandas()
    sample.unpersist()
    n = len(seen)
    dense = np.array(seen["patterns"].tolist(), bool).reshape(n, len(PATTERNS))
    columns = np.concatenate([np.zeros(0, np.int32), *seen["found"]]).astype(np.int64)
    rows = np.repeat(np.arange(n), [len(f) for f in seen["found"]])
    voter = np.full(len(known), -1)
    voter[np.searchsorted(known, voting)] = np.arange(len(voting))
    matrix = np.zeros((n, len(voting) + len(PATTERNS)), bool)
    own = voter[columns] >= 0
    matrix[rows[own], voter[columns[own]]] = True
    matrix[:, len(voting) :] = dense
    target = label_model(matrix, prior) if len(voting) else np.full(n, prior)
    w, d, c = fit_linear(rows, columns, n, len(known), dense.astype(float), target)
    return Model(bases, known, w, d, c)


def score(text: Column, model: Model) -> Column:
    """Toxicity of a text column from 0 to 1; null and empty texts score as texts without terms."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *[model.score(part) for _, _, part in blocks(texts)]]))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated rows and null ids included."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), read_labels(spark, sf_dir, "toxic"))
