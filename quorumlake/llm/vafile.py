"""Exact top-k search by inner product with a vector-approximation file.

Equal vectors are one class, with their smallest ids. The file has a byte a component: the cell of an even
grid between a component's extremes. Blocks of query vectors are broadcast to it. A first scan bounds every
score from both sides and keeps each query's k greatest lower bounds; no class whose upper bound is under
the kth of them can be among the first k. A second scan gives the classes that remain, in the order of
their upper bounds. Exact vectors are read for the first few; what comes after is read only if its bound
reaches the kth exact score so far. Then the result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.shared import drop_table, scratch, table

#: Results of a query; one id of so many is a query; cells of a component; components times 256 are integers.
K, EVERY, CELLS, SCALE = 5, 50, 64, 256
#: Numbers in a block of queries that is broadcast, at most, whatever the number of queries: 8 MB.
BLOCK = 1 << 20
#: Numbers in a table of scores that a task makes at once.
_AT_ONCE = 1 << 22
#: Exact vectors read for a query before the kth score decides on the rest, in multiples of k.
FIRST = 4
#: Components are whole numbers of at most so many bits, so that sums of products fit a long.
_BITS = 26


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of rows (vec_id, embedding): v is floor(SCALE * x) of each component x.

    Rows without an id take no part, nor vectors that are null or empty or hold null or non-finite components.
    """
    x = F.col("embedding")
    plain = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.coalesce(plain, F.lit(False)))
    large = F.exists(x, lambda y: F.abs(SCALE * y.cast("double")) >= float(1 << _BITS))
    v = F.when(large, F.raise_error(F.lit(f"a component is beyond {_BITS} bits"))).otherwise(F.transform(x, lambda y: F.floor(SCALE * y.cast("double")).cast("int")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null")


def classes(vectors: DataFrame, most: int) -> DataFrame:
    """(class, v, ids): equal vectors of vectors (vec_id, v), known by their smallest id, with their first `most` ids.

    The limit of the window works before the shuffle too, so that a vector of very many rows is few rows a task.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    first = vectors.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    ids = F.array_sort(F.collect_set("vec_id"))
    return first.groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("class"), "v", "ids")


class Grid:
    """Cells of each component: from low on, each of width whole numbers."""

    def __init__(self, vectors: DataFrame):
        ends = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
        self.low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for r in ends:
            self.low[r["at"]], high[r["at"]] = r["low"], r["high"]
        # shorter vectors count as followed by zeros
        self.low, high = np.minimum(self.low, 0), np.maximum(high, 0)
        self.width = (high - self.low) // CELLS + 1

    def cells(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.low) // self.width).astype(np.uint8)

    def matrix(self, rows: list) -> np.ndarray:
        out = np.zeros((len(rows), len(self.low)), np.int64)
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out

    def bounds(self, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base, under, over: the score of query q (row) and cell code (column) lies between base + under and base + over."""
        base = product(q * self.width, codes.astype(np.int64).T) + (q @ self.low)[:, None]
        return base, np.minimum(q, 0) @ (self.width - 1), np.maximum(q, 0) @ (self.width - 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of whole-number matrices, exactly: by doubles where all sums are whole in them."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _pieces(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _AT_ONCE // max(1, wide))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _codes(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), dims)


def candidates(file: DataFrame, grid: Grid, q: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """(query, class, bound): of file (class, cells), the classes that may be among the first k of the queries q, known by names."""
    shared = file.sparkSession.sparkContext.broadcast((q, names))

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, _ = shared.value
        best = np.zeros((len(q), 0), np.int64)
        for b in _pieces(batches, len(q)):
            base, under, _ = grid.bounds(q, _codes(b.column("cells"), len(grid.low)))
            best = np.concatenate([best, base + under[:, None]], axis=1)
            if best.shape[1] > k:
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
        n = best.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(best.ravel())], ["slot", "low"])

    w = Window.partitionBy("slot").orderBy(F.desc("low"))
    least = file.select("cells").mapInArrow(lows, "slot long, low long").withColumn("at", F.row_number().over(w)).where(F.col("at") == k)
    # a number a query of the block
    floor = np.full(len(q), np.iinfo(np.int64).min)
    for r in least.select("slot", "low").collect():
        floor[r["slot"]] = r["low"]
    floors = file.sparkSession.sparkContext.broadcast(floor)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = shared.value
        for b in _pieces(batches, len(q)):
            base, _, over = grid.bounds(q, _codes(b.column("cells"), len(grid.low)))
            bound = base + over[:, None]
            i, j = np.nonzero(bound >= floors.value[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), b.column("class").take(pa.array(j)), pa.array(bound[i, j])], ["query", "class", "bound"])

    return file.mapInArrow(kept, "query long, class long, bound long")


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, class, score) of pairs (query, class): the vectors (class, v) of both are read."""
    met = pairs.select("query", "class").join(vectors.select("class", "v"), "class")
    met = met.join(queries.select(F.col("class").alias("query"), F.col("v").alias("q")), "query")
    product = F.zip_with("v", "q", lambda a, b: F.coalesce(a.cast("long") * b, F.lit(0).cast("long")))
    return met.select("query", "class", F.aggregate(product, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def nearest(all_classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, class, score): the k best classes of all_classes (class, v) of each class asked (class), ties to the smaller class.

    Of the k best rows none is of another class, as each class has its smallest id for a name.
    """
    spark = all_classes.sparkSession
    queries = table(all_classes.join(asked, "class", "left_semi").select("class", "v"), "query-vectors")
    grid = Grid(all_classes)
    if not len(grid.low):
        return spark.createDataFrame([], "query long, class long, score long")

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"class": b["class"], "cells": [c.tobytes() for c in grid.cells(grid.matrix(list(b["v"])))]})

    file = table(all_classes.select("class", "v").mapInPandas(approximate, "class long, cells binary"), "approximations")
    path, schema = scratch(spark, "nearest"), "query long, class long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    # blocks of queries come to the driver one by one, each of at most BLOCK numbers
    for names, q in _blocks(queries, grid, max(1, BLOCK // len(grid.low))):
        may = table(candidates(file, grid, q, names, k), "candidates")
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "class")
        first = may.withColumn("at", F.row_number().over(order)).where(F.col("at") <= FIRST * k)
        read_first = table(_exact(first, all_classes, queries), "exact")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
        kth = read_first.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("query", F.col("score").alias("kth"))
        # where fewer than k were read there is no more to read
        rest = may.join(first.select("query", "class"), ["query", "class"], "left_anti").join(kth, "query").where("bound >= kth")
        part = read_first.unionByName(_exact(rest, all_classes, queries))
        part.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at").write.mode("append").parquet(path)
        drop_table(may)
        drop_table(read_first)
    return spark.read.schema(schema).parquet(path)


def _blocks(queries: DataFrame, grid: Grid, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    names, rows = [], []
    for r in queries.toLocalIterator():
        names.append(r["class"])
        rows.append(r["v"])
        if len(names) == size:
            yield np.array(names, np.int64), grid.matrix(rows)
            names, rows = [], []
    if names:
        yield np.array(names, np.int64), grid.matrix(rows)


def top(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest integer inner product of each row whose id is divisible by every.

    Ties go to the smaller vec_id. A query doesn't find its own row. Rows without an id, and vectors that are null,
    empty or hold null or non-finite components, take no part. Rows of the same id and vector are one; rows
    of one id and different vectors are different rows. Of vectors of different length the shorter one counts
    as followed by zeros. Components of 2 ** _BITS / SCALE or more raise an error, as sums might not fit a long. An empty
    table gives no rows; other columns are ignored.
    """
    vectors = table(integers(rows.select("vec_id", "embedding")), "vectors")
    # of k + 1 rows, one may be the query's own
    all_classes = table(classes(vectors, k + 1), "classes")
    own = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    ids = own.join(all_classes.select("class", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    ids = table(ids, "queries")
    found = nearest(all_classes, ids.select(F.col("query").alias("class")).distinct(), k + 1)
    found = found.join(all_classes.select("class", "ids"), "class").select("query", "class", "score", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1).drop("at")
    met = ids.join(found, "query").where("vec_id <> query_id or class <> query")
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    met = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return met.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(name: str = "embeddings") -> str:
    """DuckDB SQL for top: each query against all rows."""
    return f"""
        with v as (select distinct vec_id, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) v from {name}
            where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) score from v a join v b on a.vec_id % {EVERY} = 0 and (a.vec_id <> b.vec_id or a.v <> b.v))
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= {K}"""
