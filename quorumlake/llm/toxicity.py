"""Toxicity by a classifier chain over categories.

The categories are predicted one after another by logistic models on hashed words; each later model
also takes the earlier categories' probabilities, which in training come out of fold: a row's are made by
models that never saw it. The last link of the chain is toxicity itself, as labelled. The categories
before it are found in the data: labelled toxic rows are clustered by the words that tell them from the
others, the most frequent cluster first.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.features import Rows, labelled_sample
from quorumlake.llm.shared import small_batches

#: Labelled rows that the chain is fitted on, at most.
TRAIN_ROWS = 12_000
BUCKETS, KEPT, FOLDS, EVIDENCE = 1 << 20, 2000, 5, 12.0
_WORD = regex.compile(r"[\p{L}\p{M}]+")

#: Clusters of toxic rows, and the words, of most evidence, that they are told by.
KINDS, TELLING = 3, 200
CATEGORIES = (*[f"kind_{k + 1}" for k in range(KINDS)], "toxic")


def features(text: str | None) -> np.ndarray:
    """A bucket for each distinct word of the whole text, in lower case."""
    words = set(_WORD.findall((text or "").lower()))
    return np.array(sorted({crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words}), np.int64)


def _extract(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


@dataclass
class Link:
    """One model: chosen buckets with weights, weights of earlier probabilities, and a bias."""

    place: np.ndarray
    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def log_odds(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.place, rows.idx)
        at = np.minimum(at, max(0, len(self.place) - 1))
        w = np.where(self.place[at] == rows.idx, self.words[at], 0.0) if len(self.place) else np.zeros(len(rows.idx))
        return np.clip(rows.sums(w) + before @ self.earlier + self.bias, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def evidence(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Chi-square of each bucket that goes with y more than chance has it; 0 for the others and rare ones."""
    seen = np.bincount(rows.idx, minlength=BUCKETS).astype(float)
    hits = np.bincount(rows.idx, y[rows.owner()], BUCKETS)
    expected = seen * y.mean()
    lift = np.where(hits > expected, (hits - expected) ** 2 / np.maximum(expected * (1 - y.mean()), 1e-9), 0)
    lift[seen < 3] = 0
    return lift


def telling(rows: Rows, y: np.ndarray, most: int) -> np.ndarray:
    """The buckets of clear evidence for y, in order, at most `most`."""
    lift = evidence(rows, y)
    place = np.flatnonzero(lift >= EVIDENCE)
    return np.sort(place[np.argsort(-lift[place], kind="stable")[:most]])


def kinds(rows: Rows, toxic: np.ndarray, most: int = KINDS, rounds: int = 20) -> np.ndarray:
    """(rows, most) of 0 and 1: the cluster of each toxic row, by the telling words it has; none without any.

    Means are taken by cosine; the first is the row of most telling words, each next the row farthest
    from those before.
    """
    out = np.zeros((len(rows), most))
    if not len(toxic) or toxic.min() == toxic.max():
        return out
    place = telling(rows, toxic, TELLING)
    new = np.full(BUCKETS, -1)
    new[place] = np.arange(len(place))
    col, who = new[rows.idx], rows.owner()
    has = (col >= 0) & (toxic[who] > 0)
    x = np.zeros((len(rows), len(place)))
    x[who[has], col[has]] = 1
    some = np.flatnonzero(x.any(1))
    if not len(some):
        return out
    x = x[some] / np.linalg.norm(x[some], axis=1, keepdims=True)
    means = [x[np.argmax((x > 0).sum(1))]]
    while len(means) < most:
        means.append(x[np.argmin(np.max(x @ np.array(means).T, axis=1))])
    means = np.array(means)
    for _ in range(rounds):
        own = np.argmax(x @ means.T, axis=1)
        for k in range(most):
            if (own == k).any():
                total = x[own == k].sum(0)
                means[k] = total / np.linalg.norm(total)
    rank = np.argsort(np.argsort(-np.bincount(own, minlength=most), kind="stable"), kind="stable")
    out[some, rank[own]] = 1
    return out


def fit_link(rows: Rows, before: np.ndarray, y: np.ndarray, steps: int = 250, l2: float = 0.05) -> Link:
    """Logistic regression on words that clearly go with y, found by chi-square, and on earlier probabilities."""
    none = np.zeros(0, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Link(none, np.zeros(0), np.zeros(before.shape[1]), bias)
    who = rows.owner()
    place = telling(rows, y, KEPT)
    new = np.full(BUCKETS, -1)
    new[place] = np.arange(len(place))
    col = new[rows.idx]
    col, who = col[col >= 0], who[col >= 0]
    w, u, b = np.zeros(len(place)), np.zeros(before.shape[1]), bias
    m = [np.zeros_like(w), np.zeros_like(u), 0.0]
    v = [np.zeros_like(w), np.zeros_like(u), 0.0]
    for t in range(1, steps + 1):
        z = np.bincount(who, w[col], len(y)) + before @ u + b
        e = _sigmoid(np.clip(z, -30, 30)) - y
        grads = [(np.bincount(col, e[who], len(w)) + l2 * w) / len(y), (before.T @ e + l2 * u) / len(y), e.mean()]
        steps_by = []
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            steps_by.append(0.25 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
        w, u, b = w - steps_by[0], u - steps_by[1], b - steps_by[2]
    return Link(place, w, u, float(b))


@dataclass
class Chain:
    categories: tuple[str, ...]
    links: list[Link]

    def probabilities(self, rows: Rows) -> np.ndarray:
        before = np.zeros((len(rows), 0))
        for link in self.links:
            before = np.column_stack([before, _sigmoid(link.log_odds(rows, before))])
        return before


def fit(rows: Rows, targets: np.ndarray, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """targets has a column of 0 and 1 for each category, in the order of the chain."""
    held = np.arange(len(rows)) % FOLDS
    before, links = np.zeros((len(rows), 0)), []
    parts = [(np.flatnonzero(held != k), np.flatnonzero(held == k)) for k in range(FOLDS)]
    for c in range(targets.shape[1]):
        y = targets[:, c].astype(float)
        out = np.zeros(len(rows))
        if c + 1 < targets.shape[1]:
            for a, b in parts:
                out[b] = _sigmoid(fit_link(rows.take(a), before[a], y[a]).log_odds(rows.take(b), before[b]))
        links.append(fit_link(rows, before, y))
        before = np.column_stack([before, out])
    return Chain(categories, links)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Chain:
    """Fits on documents with labels (doc_id, toxic)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labels = labels.where(F.col("toxic").isin(0, 1))
    got = labelled_sample(rows, labels, ["toxic"], most, _extract, ["text"], balanced=True)
    lists, toxic = list(got["features"]), got["toxic"].to_numpy(float)
    found = Rows.of(lists)
    chain = fit(found, np.column_stack([kinds(found, toxic), toxic]))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(counts) == 2 and 0 < toxic.sum() < len(toxic):
        # the sample's share of toxic rows is not the labels'
        chain.links[-1].bias += float(np.log(counts[1] / counts[0]) - np.log(toxic.sum() / (len(toxic) - toxic.sum())))
    return chain


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, score of toxicity (0 to 1), predicted (1 if score >= 0.5), p_<category>.

    Null texts count as empty. Equal texts get equal scores; without labels every probability is 0.5;
    an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most))

    @F.pandas_udf("array<double>")
    def chained(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.value.probabilities(Rows.of([features(t) for t in texts]))))

    rows = docs.select("doc_id", chained(F.col("text").cast("string")).alias("p"))
    rows = rows.select("doc_id", F.col("p")[KINDS].alias("score"), *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(CATEGORIES[:-1])])
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
