"""Mixing to target weights by soft membership.

A classifier learned on labelled rows gives every document a posterior over domains.  Document rates,
none negative, start at one and follow projected gradients of the squared errors of the domains'
expected token totals, each over the domain's own total, scaled by how the totals answer to a step.  A step needs only sums over
documents, so each costs one distributed pass; a document's rate is recomputed from the few gradient
vectors there have been, and nothing is kept for it.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, small_batches, stored
from .features import WHITE
from .labelled import labelled_texts, read_labels

#: Labelled rows that the classifier is learned from, at most about.
LABELLED = 20_000
#: Passes at most, and the relative error of all totals at which they end.
STEPS, CLOSE = 60, 1e-4
#: Up to so many domains a step is scaled by their joint answers, a square of sums; beyond, by each domain's own total.
JOINT = 64
#: The registered query's targets: domain shares to this power, at the corpus' number of tokens.
TEMPERATURE = 0.7


def byte_shares(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(root of each byte's share, number of words parted by ASCII white space) of each text."""
    n = len(part)
    sizes = np.array([len(x) for x in part], np.int64)
    data = np.frombuffer(b"".join(part).lower(), np.uint8)
    text = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256)
    word = ~WHITE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    begins[first] = word[first]
    return np.sqrt(counts / np.maximum(sizes, 1)[:, None]), np.bincount(text[begins], minlength=n)


class Classifier:
    """Softmax regression on byte shares."""

    def __init__(self, domains: list[str], weights: np.ndarray):
        self.domains, self.weights = domains, weights

    def posterior(self, shares: np.ndarray) -> np.ndarray:
        z = np.concatenate([shares, np.ones((len(shares), 1))], axis=1) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(shares: np.ndarray, domain: np.ndarray, domains: list[str], steps: int = 300, rate: float = 0.2, decay: float = 1e-5) -> Classifier:
    model = Classifier(domains, np.zeros((257, len(domains))))
    x = np.concatenate([shares, np.ones((len(shares), 1))], axis=1)
    target = np.eye(len(domains))[domain]
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        step = x.T @ (model.posterior(shares) - target) / max(len(x), 1) + decay * model.weights
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step * step
        model.weights -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, domain: str = "lang") -> Classifier | None:
    """A classifier of the domain column, learned from the labelled rows among docs; None where these have no domain."""
    named = docs.select("doc_id", F.struct("text", F.col(domain).alias("domain")).alias("text"))

    @F.pandas_udf("binary")
    def shares(texts: pd.Series) -> pd.Series:
        rows = [byte_shares(part)[0].astype(np.float32) for _, _, part in blocks(texts)]
        return pd.Series([r.tobytes() for block in rows for r in block], dtype=object)

    of = lambda c: F.struct(c["domain"].alias("domain"), shares(c["text"]).alias("x"))
    rows = labelled_texts(named, labels, LABELLED, salt=4, of=of).select("text.*").where("domain is not null").toPandas()
    domains = sorted(rows["domain"].unique())
    if not domains:
        return None
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, 256).astype(np.float64)
    return fit(x, np.searchsorted(domains, rows["domain"].to_numpy()), domains)


def memberships(docs: DataFrame, model: Classifier, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, p): words and domain posteriors of every row; null texts count as empty."""

    @F.pandas_udf("n_tokens long, p array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        tokens, p = [], []
        for _, _, part in blocks(texts):
            shares, words = byte_shares(part)
            tokens += words.tolist()
            p += list(model.posterior(shares))
        return pd.DataFrame({"n_tokens": tokens, "p": p})

    return docs.select(F.col(key), run("text").alias("m")).select(key, "m.*")


def _rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each document's rate after the steps: one a row, a gradient vector over domains and the momentum it starts with."""
    rate = last = np.ones(len(p))
    for *gradient, momentum in steps:
        rate, last = np.maximum(0, rate + momentum * (rate - last) - p @ gradient), rate
    return rate


def answers(members: DataFrame, steps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Expected tokens of each domain at the rates after the steps, and, up to JOINT domains, those of each pair that move with a step."""
    joint = k <= JOINT

    def run(frames):
        have, both = np.zeros(k), np.zeros((k, k) if joint else (0, k))
        for frame in frames:
            if len(frame):
                p, n = np.stack(frame["p"].to_numpy()), frame["n_tokens"].to_numpy()
                rate = _rates(p, steps)
                have += (rate * n) @ p
                if joint:
                    both += (p * (n * (rate > 0))[:, None]).T @ p
        d, e = np.nonzero(np.vstack([have[None], both]))
        yield pd.DataFrame({"d": d.astype(np.int64) - 1, "e": e.astype(np.int64), "x": np.vstack([have[None], both])[d, e]})

    sums = members.select("n_tokens", "p").mapInPandas(run, "d long, e long, x double").groupBy("d", "e").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((k + 1, k))
    out[sums["d"] + 1, sums["e"]] = sums["x"]
    return out[0], out[1:] if joint else None


def totals(members: DataFrame, steps: np.ndarray, k: int) -> np.ndarray:
    """Expected tokens of each domain at the rates after the steps."""
    return answers(members, steps, k)[0]


@dataclass(frozen=True)
class Fit:
    """Gradient steps and their momenta, one a row; the domains' totals they lead to; their largest relative error; domains with a target that no document has a share in."""

    steps: np.ndarray
    totals: np.ndarray
    error: float
    unreached: tuple[str, ...]


def fit_rates(members: DataFrame, targets: dict[str, float], domains: list[str]) -> Fit:
    """Gradient steps whose rates, none negative, bring the domains' expected tokens as near to targets as they can.

    A step is scaled by the inverse of the totals' joint answer and shortened where it doesn't lower the
    squared error.  Where no such step lowers it, as some targets can't be met, plain steps with momentum
    lead towards the least squares.  Totals that stay off their targets, because no rates meet them or the
    passes ran out, are reported in error and by a warning; a domain without tokens can't be moved and is
    named in unreached.
    """
    k = len(domains)
    target = np.array([targets.get(d, 0.0) for d in domains], float)
    steps = np.zeros((0, k + 1))
    scale, both = answers(members, steps, k)
    have, last, some = scale, scale, scale > 1e-9
    unreached = tuple(d for d, s, t in zip(domains, some, target) if not s and t > 0)

    def off(x: np.ndarray) -> np.ndarray:
        return np.where(some, (x - target) / np.where(some, scale, 1), 0.0)

    length, plain, run, passes = 1.0, both is None, 0, 1
    while np.abs(off(have)).max(initial=0) > CLOSE and passes < STEPS:
        momentum = run / (run + 3) if plain else 0.0
        # Totals are linear in rates, so those at the point a momentum leads to need no pass.
        error = off(have + momentum * (have - last))
        step = error if plain else length * np.linalg.lstsq(both / np.where(some, scale, 1)[:, None], error, rcond=1e-9)[0]
        trial = np.vstack([steps, np.r_[step, momentum]])
        new, new_both = answers(members, trial, k)
        passes += 1
        gain = (scale * (off(have) ** 2 - off(new) ** 2)).sum()
        if gain > 1e-9 * (scale * off(have) ** 2).sum():
            steps, have, last, both, length, run = trial, new, have, new_both, min(1.0, 2 * length), run + plain
        elif plain and run:
            run = 0
        elif plain:
            break
        elif length > 1e-2:
            length /= 4
        else:
            plain = True
    worst = float(np.abs(off(have)).max(initial=0))
    if worst > CLOSE or unreached:
        warnings.warn(f"mixing: totals are off their targets by up to {worst:.3g} after {passes} passes; unreached: {unreached}", stacklevel=2)
    return Fit(steps, have, worst, unreached)


def tempered(have: np.ndarray, domains: list[str], temperature: float, keep_all: bool) -> dict[str, float]:
    """Targets with domain shares to a power; at the same number of tokens, or, with keep_all, at the least at which no domain shrinks."""
    total = have.sum()
    if not total:
        return dict.fromkeys(domains, 0.0)
    share = have / total
    weight = np.where(share > 0, share, 0) ** temperature * (share > 0)
    weight /= weight.sum()
    growth = (share[share > 0] / weight[share > 0]).max() if keep_all else 1.0
    return dict(zip(domains, (weight * total * growth).tolist()))


def rated(members: DataFrame, steps: np.ndarray, domains: list[str]) -> DataFrame:
    """members with domain (the likeliest), its posterior, and the rate."""

    @F.pandas_udf("domain string, posterior double, rate double")
    def run(rows: pd.Series) -> pd.DataFrame:
        p = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(domains)))
        return pd.DataFrame({"domain": [domains[i] for i in p.argmax(1)], "posterior": p.max(1), "rate": _rates(p, steps)})

    return members.withColumn("_r", run("p")).select(*[c for c in members.columns if c != "p"], "_r.*")


def mix_documents(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, keep_all: bool = False) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, error) for every row, repeated rows and null ids included.

    error: the largest relative error of a domain's expected tokens, the same in every row.  Without a labelled row that has a domain there are no targets: domain and posterior are null and
    every rate is one.
    """
    model = train(small_batches(docs), labels)
    if model is None:
        empty = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), lambda w: w != "")).cast("long").alias("n_tokens"))
        return empty.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(0.0).alias("error"))
    members = stored(memberships(docs, model), "members")
    targets = tempered(totals(members, np.zeros((0, len(model.domains) + 1)), len(model.domains)), model.domains, temperature, keep_all)
    found = fit_rates(members, targets, model.domains)
    return rated(members, found.steps, model.domains).withColumn("error", F.lit(found.error))


def copies(rate: Column, key: Column) -> Column:
    """A whole number of copies that has the rate as its mean over keys: the fraction is decided by the key's hash."""
    whole = F.floor(rate)
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (whole + F.when(chance < rate - whole, 1).otherwise(0)).cast("int")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir), read_labels(spark, sf_dir, "quality"))
