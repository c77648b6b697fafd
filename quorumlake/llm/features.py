"""Bounded samples of labelled rows, and sparse rows of hashed words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import small_batches


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


@dataclass
class Rows:
    """Sparse rows: at[i]:at[i + 1] of idx are the features of row i, val their values."""

    idx: np.ndarray
    at: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray], values: list[np.ndarray] | None = None) -> Rows:
        at = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        idx = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)
        val = np.concatenate([np.zeros(0), *values]) if values is not None else np.ones(len(idx))
        return cls(idx, at, val)

    def __len__(self) -> int:
        return len(self.at) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over each row of x, which has a row for each feature."""
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.at)[rows]
        own = np.repeat(self.at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Rows(self.idx[own], np.r_[0, np.cumsum(n)], self.val[own])


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, extract: Callable, inputs: list[str], balanced: bool = False) -> pd.DataFrame:
    """At most `most` labelled documents, those of least id hash: label_id, label columns and features.

    balanced: of a single label column of 0 and 1, at most half of them for either value.

    extract makes an array of numbers of the inputs on the executors; only that comes to the driver.
    Labels that are null or disagree for an id are left out.
    """
    small_batches(docs.sparkSession)
    some = labels.select(F.col("doc_id").cast("long").alias("label_id"), *columns).dropna()
    some = some.groupBy("label_id").agg(*[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"{c}_most") for c in columns])
    for c in columns:
        some = some.where(F.col(c) == F.col(f"{c}_most")).drop(f"{c}_most")
    order = F.xxhash64("label_id")
    first = lambda x, n: x.orderBy(order, "label_id").limit(n)
    if balanced:
        some = first(some.where(F.col(columns[0]) == 1), most // 2).unionByName(first(some.where(F.col(columns[0]) == 0), most // 2))
    some = F.broadcast(first(some, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), *inputs).join(some, "label_id")
    udf = F.pandas_udf(lambda *x: extract(*x).map(lambda y: y.astype(np.int32).tobytes()), "binary")
    rows = rows.select("label_id", *columns, udf(*inputs).alias("features"))
    got = rows.orderBy(order, "label_id", F.hash("features")).limit(most).toPandas()
    got["features"] = [np.frombuffer(x, np.int32) for x in got["features"]]
    return got
