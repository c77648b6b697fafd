"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise term sum_{i<j} <v_i, v_j> x_i x_j is had in linear time as half the difference of the
squared sum and the sum of squares. It is trained on the driver on a bounded sample (TRAIN_ROWS) by
Adagrad; scoring is a pandas UDF with the model broadcast, whose size is fixed by BUCKETS and RANK.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import quality_rules as R
from quorumlake.llm.features import Rows, fold, labelled_sample
from quorumlake.llm.shared import fresh, small_batches

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 12_000
BUCKETS, RANK, BINS = 1 << 17, 8, 16
N_STATS = 12
SIZE = BUCKETS + N_STATS * BINS


def _level(x: float, scale: float = 1.0) -> int:
    """A bin that doubles: 0 for none, then one for each power of two from scale on."""
    return int(min(BINS - 1, max(0, np.log2(max(x, 1e-12) / scale) + 1))) if x > 0 else 0


def features(text: str | None, n_chars: float | None) -> np.ndarray:
    """Indices: a bucket for each distinct word, then one of BINS for each statistic."""
    text = text or ""
    s = dict(zip(R.STATS, R.stats(text)))
    words = set(text.encode("utf-8", "surrogatepass").split())
    n, chars, lines, letters = max(1, s["n_words"]), max(1, s["word_chars"]), max(1, s["n_lines"]), max(1, s["n_letters"])
    known = n_chars if n_chars is not None and n_chars == n_chars else len(text)
    levels = [
        _level(s["n_words"], 8), _level(s["word_chars"] / n, 0.5), _level(s["n_symbols"] / n, 1 / 256), _level(s["n_dup_lines"] / lines, 1 / 64),
        _level(s["n_repeat_words"] / n, 1 / 128), _level(s["n_lines"]), _level(s["n_upper"] / letters, 1 / 64), _level(s["n_letters"] / chars, 0.25),
        _level(s["n_shouted"] / n, 1 / 128), _level(s["n_common"]), _level(len(words) / n, 1 / 256), _level(max(0, known), 16),
    ]
    buckets = {crc32(w) & (BUCKETS - 1) for w in words}
    return np.array([*sorted(buckets), *(BUCKETS + k * BINS + v for k, v in enumerate(levels))], np.int64)


def _extract(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([features(t, n) for t, n in zip(texts, sizes)])


def weighed(lists: list[np.ndarray]) -> Rows:
    """Words share one unit of length, statistics have a unit each."""
    values = []
    for x in lists:
        w = max(1, len(x) - N_STATS)
        values.append(np.r_[np.full(len(x) - N_STATS, w**-0.5), np.full(N_STATS, 0.5)])
    return Rows.of(lists, values)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[rows.idx] * rows.val[:, None]
        total = rows.sums(vx)
        pairs = 0.5 * (total**2 - rows.sums(vx**2)).sum(1)
        return self.bias + rows.sums(self.linear[rows.idx] * rows.val) + pairs, total

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -40, 40)))


def fit(rows: Rows, y: np.ndarray, rounds: int = 6, batch: int = 256, rate: float = 0.1, l2: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss; with no rows every score is 0.5, with one class it is that class."""
    random = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(SIZE), random.normal(0, 0.02, (SIZE, RANK)))
    if not len(rows):
        return Machine(0.0, m.linear, np.zeros_like(m.factors))
    share = (y.sum() + 0.5) / (len(y) + 1)
    m.bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Machine(m.bias, m.linear, np.zeros_like(m.factors))
    g_lin, g_fac, g_bias = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    for _ in range(rounds):
        order = random.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = rows.take(own := order[k : k + batch])
            raw, total = m.raw(part)
            e = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[own]
            at, inv = np.unique(part.idx, return_inverse=True)
            who = part.owner()
            d = (e[who] * part.val) / len(own) * 16
            lin = np.bincount(inv, d, len(at)) + l2 * m.linear[at]
            fac = np.empty((len(at), RANK))
            for r in range(RANK):
                fac[:, r] = np.bincount(inv, d * (total[who, r] - m.factors[part.idx, r] * part.val), len(at))
            fac += l2 * m.factors[at]
            g_lin[at] += lin**2
            g_fac[at] += fac**2
            m.linear[at] -= rate * lin / np.sqrt(g_lin[at])
            m.factors[at] -= 0.5 * rate * fac / np.sqrt(g_fac[at])
            b = e.mean() * 4
            g_bias += b * b
            m.bias -= rate * b / g_bias**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """Fits on documents whose id is in labels (doc_id, quality) and whose fold of 3 is not 1."""
    labels = labels.where(fold("doc_id", 3).isin(0, 2) & F.col("quality").isin(0, 1))
    got = labelled_sample(_inputs(docs), labels, ["quality"], most, _extract, ["text", "n_chars"])
    return fit(weighed(list(got["features"])), got["quality"].to_numpy(float))


def _inputs(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), size.alias("n_chars"))


def scorer(docs: DataFrame, machine: Machine):
    """A column that scores text (and n_chars, where docs have it): 0 to 1, higher is better."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))

    @F.pandas_udf("double")
    def score(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = [Machine(*model.value).score(weighed([features(t, n) for t, n in zip(texts[k : k + 200], sizes[k : k + 200])])) for k in range(0, len(texts), 200)]
        return pd.Series(np.concatenate([np.zeros(0), *out]))

    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return score(F.col("text").cast("string"), size)


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Null texts count as empty; both get a score. Equal rows get equal scores. Null ids are in no fold
    (held_out false) and train nothing. Empty labels give 0.5 for all; extra columns are ignored.
    """
    rows = docs.select("doc_id", scorer(docs, train(docs, labels, most)).alias("score"))
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, that are scored 0.5 or more."""
    at = fresh(docs.columns, "quality_score")
    return docs.withColumn(at, scorer(docs, train(docs, labels, most))).where(F.col(at) >= 0.5).drop(at)
