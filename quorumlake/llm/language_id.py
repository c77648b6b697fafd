"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; a linear classifier per bit predicts it from hashed n-grams of the whole
text, and loss-weighted decoding picks the codeword of least loss, bits counting by how well they did
on the training rows. A small lead over the second codeword flags the document as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.features import fold
from quorumlake.llm.shared import small_batches

#: Labelled rows that the classifiers are fitted on, about; they are shared out evenly to languages,
#: but at least LEAST_ROWS each.
TRAIN_ROWS, LEAST_ROWS = 1600, 20
BUCKETS = 1 << 13
AMBIGUOUS = 0.6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(text: str | None) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams of the lower-cased text, by bucket."""
    x = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    if len(x) > 1:
        two = (x[:-1] << np.uint32(8)) | x[1:]
        out += np.bincount((two * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
        three = ((two[:-1] << np.uint32(8)) | x[2:]) + np.uint32(1 << 24)
        out += np.bincount((three * np.uint32(2246822519)) >> np.uint32(19), minlength=BUCKETS)
    return out


def unit(counts: np.ndarray) -> np.ndarray:
    """Rows of square roots of counts, of length 1; empty rows stay zero."""
    x = np.sqrt(counts, dtype=np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    return x


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, far apart. Up to six languages: every split of them in two; beyond, the
    best of some seeded codes of about ten bits per doubling."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c], float).T
    random = np.random.default_rng(11)
    best, apart = None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        d = (code.shape[1] - code @ code.T) / 2
        if (least := d[~np.eye(n, dtype=bool)].min()) > apart:
            best, apart = code, least
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Mean weighted squared hinge of each language's codeword."""
        bits = x @ self.weights + self.bias
        margin = np.maximum(0, 1 - bits[:, None, :] * self.code[None])
        return (margin**2 @ self.trust) / max(self.trust.sum(), 1e-9)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its share among exp(-loss)."""
        loss = self.losses(x)
        p = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        best = loss.argmin(1)
        return best, p[np.arange(len(p)), best] / p.sum(1)


def fit(x: np.ndarray, languages: list[str], y: np.ndarray, ridge: float = 0.3) -> Codes:
    """A ridge classifier per bit, solved in the space of the rows."""
    code = codewords(len(languages))
    target = code[y]
    mean = target.mean(0)
    gram = (x @ x.T).astype(np.float64)
    gram[np.diag_indices(len(x))] += ridge
    weights = (x.T @ np.linalg.solve(gram, target - mean).astype(np.float32)).astype(np.float32)
    right = (np.sign(x @ weights + mean) == target).mean(0)
    return Codes(languages, code, weights, mean, np.maximum(right - 0.5, 0.01))


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Codes | None:
    """Fits on text and non-null lang of documents whose fold of 4 is not 2; None if there are none.

    The sample keeps, of each language, the ids whose hash is least: a share set by the language's
    count, so that no group is gathered anywhere.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(fold("doc_id", 4).isin(0, 1, 3) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    each = max(LEAST_ROWS, most // len(languages))
    part = F.lit(1.0)
    for name in languages:
        part = F.when(F.col("lang") == name, F.lit(min(1.0, each / counts[name]))).otherwise(part)

    @F.pandas_udf("binary")
    def sparse(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = grams(t)
            at = np.flatnonzero(c)
            out.append(np.stack([at, c[at]]).astype(np.int32).tobytes())
        return pd.Series(out)

    order = F.xxhash64("doc_id")
    # exact up to chance: as many ids as the share of hashes; a few of any language are always kept
    own = rows.where((order / float(1 << 63) + 1) / 2 < F.greatest(part, F.lit(0.0)))
    got = own.select("lang", order.alias("o"), sparse("text").alias("g")).orderBy("o", "lang", F.hash("g")).limit(2 * each * len(languages) + 100).toPandas()
    if got["lang"].nunique() < len(languages):
        missing = [x for x in languages if x not in set(got["lang"])]
        for name in missing:
            more = rows.where(F.col("lang") == name).select("lang", order.alias("o"), sparse("text").alias("g"))
            got = pd.concat([got, more.orderBy("o", F.hash("g")).limit(5).toPandas()])
    counted = np.zeros((len(got), BUCKETS), np.float32)
    for k, g in enumerate(got["g"]):
        at, n = np.frombuffer(g, np.int32).reshape(2, -1)
        counted[k, at] = n
    y = np.array([languages.index(x) for x in got["lang"]])
    return fit(unit(counted), languages, y)


def identify(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing is
    labelled. Equal texts get equal answers; null ids are in no fold; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, most))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pred, score, doubt = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        codes = model.value
        known = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)] if codes else []
        for at in range(0, len(known), 250):
            rows = known[at : at + 250]
            best, p = codes.predict(unit(np.stack([grams(texts.iloc[k]) for k in rows])))
            for k, b, s in zip(rows, best, p):
                pred[k], score[k], doubt[k] = codes.languages[b], s, s < AMBIGUOUS
        return pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": doubt})

    rows = docs.select("doc_id", predict(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "p.lang_pred", "p.score", "p.ambiguous")
