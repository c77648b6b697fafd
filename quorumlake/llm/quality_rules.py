"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

A rule says good (+), bad (-) or nothing (0) of a document. The votes of all documents are counted by
pattern (at most 3 to the power of the rules, whatever the corpus), EM runs on those counts over a
two-class model with P(vote | class) per rule, and each document takes its pattern's posterior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import small_batches, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouted", "n_common")

# Frequent function words of English, German, French and Spanish.
COMMON = frozenset(
    b"the of and to in is that for it with as was be by on not are this from or "
    b"der die das und von zu den mit sich auf ist im dem nicht ein eine als auch "
    b"le la les et des en un une du que est pour dans sur au par pas "
    b"el los las y del se por con una su para al lo como".split()
)


def stats(text: str | None) -> tuple[int, ...]:
    """The numbers of STATS for a whole text; null and empty texts give zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    n = len(w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            again = np.zeros(n, bool)
            at = np.array([seen[x] > 1 for x in windows])
            for k in range(3):
                again[k : n - 2 + k] |= at
            repeated = int(again.sum())
    code = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper = int(code[65:91].sum())
    lead = int(code[0xC3:0xF5].sum())  # letters beyond ASCII, near enough for a rate
    return (
        n, len(text) - sum(text.count(c) for c in SPACES), sum(int(code[ord(c)]) for c in SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), upper, upper + int(code[97:123].sum()) + lead, text.count("!!"), len(COMMON.intersection(w)),
    )


def with_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, and STATS as longs) of each row; other columns are ignored."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(stats(t), np.int64) for t in texts])

    rows = docs.select("doc_id", of(F.col(column).cast("string")).alias("s"))
    return rows.select("doc_id", *[F.col("s")[k].alias(c) for k, c in enumerate(STATS)])


def _vote(good, bad):
    return F.when(bad, F.lit("-")).when(good, F.lit("+")).otherwise(F.lit("0"))


def rules() -> dict[str, F.Column]:
    """Votes by name, over STATS; a document without words makes every rate abstain or vote bad."""
    n, lines, letters = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("n_letters", F.lit(1))
    rate = lambda c, by: F.col(c) / by
    return {
        "long_enough": _vote(F.col("n_words") >= 60, F.col("n_words") < 50),
        "word_length": _vote(rate("word_chars", n).between(3.5, 9), ~rate("word_chars", n).between(2.5, 14)),
        "few_symbols": _vote(rate("n_symbols", n) < 0.02, rate("n_symbols", n) > 0.2),
        "lines_differ": _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), rate("n_dup_lines", lines) > 0.3),
        "words_differ": _vote(rate("n_repeat_words", n) < 0.1, rate("n_repeat_words", n) > 0.3),
        "not_shouted": _vote(rate("n_upper", letters) < 0.2, rate("n_upper", letters) > 0.5),
        "calm": _vote(rate("n_shouted", n) < 0.02, rate("n_shouted", n) > 0.2),
        "has_letters": _vote(rate("n_letters", F.greatest("word_chars", F.lit(1))) > 0.85, rate("n_letters", F.greatest("word_chars", F.lit(1))) < 0.7),
        "function_words": _vote(F.col("n_common") >= 2, (F.col("n_common") == 0) & (F.col("n_words") >= 50)),
    }


def expectation_maximisation(counts: dict[str, int], rounds: int = 60, smooth: float = 1.0) -> dict[str, float]:
    """Posterior of good by pattern of votes.

    The start trusts a document without a bad vote and doubts one with; equal starts give equal results.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    votes = np.array([["-0+".index(v) for v in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    post = 1 / (1 + np.exp(-((votes == 2).sum(1) * 0.5 - (votes == 0).sum(1) * 3.0)))
    n_rules = votes.shape[1]
    for _ in range(rounds):
        # a rule starts from being right more often than wrong, as smooth pseudo-documents
        prior = (smooth + (weight * post).sum()) / (2 * smooth + weight.sum())
        log_odds = np.full(len(patterns), np.log(prior / (1 - prior)))
        for j in range(n_rules):
            good = np.bincount(votes[:, j], weight * post, 3) + smooth * np.array([0.5, 1, 2])
            bad = np.bincount(votes[:, j], weight * (1 - post), 3) + smooth * np.array([2, 1, 0.5])
            log_odds += np.log(good / good.sum())[votes[:, j]] - np.log(bad / bad.sum())[votes[:, j]]
        new = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist()))


def judge(docs: DataFrame, make_rules: Callable[[], dict] = rules) -> DataFrame:
    """Per row of docs: doc_id, STATS, votes, posterior, base_failed, kept.

    Nulls and empty texts have no words and fail the base; equal rows get equal verdicts; an empty
    table gives an empty result; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    votes = F.concat(*make_rules().values())
    counted = table(with_stats(docs).withColumn("votes", votes), "rule-votes")
    # patterns are bounded by the rules: 3 ** 9
    patterns = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    post = expectation_maximisation(patterns)
    by_pattern = spark.createDataFrame(list(post.items()), "votes string, posterior double")
    judged = counted.join(F.broadcast(by_pattern), "votes", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
