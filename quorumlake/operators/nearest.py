"""The two best matches of names in a register, by a trie of each block that is searched level by level.

A row of the edit-distance table is kept for every trie node that may still lead to a match; the rows of a
level are worked out together. A search starts with a high least similarity and lowers it until two entities
are found; from then on the second one's similarity is what a node must be able to reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entities in a trie and names that one task looks up; blocks of more are dealt into several.
ENTITIES, NAMES = 20_000, 5_000
#: Least similarities that are tried in turn; at the last one everything is found.
FLOORS = (0.85, 0.7, 0.55, 0.0)
FOUND = "raw string, block string, id long, score double, visited long"


class Trie:
    """Forms by level: for each node its parent, its letter, the longest form below, and the form that ends there."""

    def __init__(self, forms: list[str], ids: list[int]):
        by_form: dict[str, list[int]] = {}
        for f, i in zip(forms, ids):
            by_form.setdefault(f, []).append(i)
        self.forms = sorted(by_form)
        # of equal forms the two smallest ids can be among the best two
        self.ids = [sorted(set(by_form[f]))[:2] for f in self.forms]
        size = np.array([len(f) for f in self.forms], np.int64)
        letters = np.zeros((len(size), max(size, default=0)), np.int64)
        for k, f in enumerate(self.forms):
            letters[k, : len(f)] = list(map(ord, f))
        differ = np.ones_like(letters, bool)
        differ[1:] = np.logical_or.accumulate(letters[1:] != letters[:-1], axis=1)
        node = np.zeros(len(size), np.int64)
        self.levels = []
        for d in range(letters.shape[1]):
            rows = np.flatnonzero(size > d)
            first = differ[rows, d]
            at = np.flatnonzero(first)
            parent, own = node[rows[at]], np.cumsum(first) - 1
            node[rows] = own
            end = np.full(len(at), -1)
            ends = size[rows] == d + 1
            end[own[ends]] = rows[ends]
            self.levels.append((parent, letters[rows[at], d], np.maximum.reduceat(size[rows], at), end))

    def best_two(self, name: str) -> tuple[list[tuple[float, int]], int]:
        """(score, id) of the best two entities, the better one first, ties by id; and how many nodes were visited."""
        visited = 0
        for floor in FLOORS:
            best, seen = self._above(name, floor)
            visited += seen
            if len(best) >= 2:
                break
        return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:2], visited

    def _above(self, name: str, least: float) -> tuple[dict[int, float], int]:
        code, n = np.array(list(map(ord, name)), np.int64), len(name)
        step = np.arange(n + 1)
        rows, alive, visited, best = step[None, :], np.zeros(1, np.int64), 0, {}
        for d, (parent, letter, longest, end) in enumerate(self.levels, 1):
            # children of nodes that are alive; nodes of a level lie in the order of their parents
            lo, hi = np.searchsorted(parent, alive), np.searchsorted(parent, alive, "right")
            count = hi - lo
            if not count.sum():
                break
            of = np.repeat(np.arange(len(alive)), count)
            kids = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[of]
            before = rows[of]
            now = np.full((len(kids), n + 1), d)
            now[:, 1:] = np.minimum(before[:, :-1] + (letter[kids][:, None] != code), before[:, 1:] + 1)
            # an insertion adds one for each step to the right
            now = np.minimum.accumulate(now - step, axis=1) + step
            visited += len(kids)
            done = np.flatnonzero(end[kids] >= 0)
            score = 1 - now[done, n] / max(n, d)
            for k in done[score >= least].tolist():
                s = 1 - int(now[k, n]) / max(n, d)
                for i in self.ids[end[kids[k]]]:
                    best[i] = max(s, best.get(i, 0.0))
            if len(best) >= 2:
                least = max(least, sorted(best.values())[-2])
            may = 1 - now.min(axis=1) / np.maximum(n, longest[kids]) >= least
            rows, alive = now[may], kids[may]
        return best, visited


def nearest_two(names: DataFrame, forms: DataFrame) -> DataFrame:
    """FOUND: for names (raw, block, a) the two best ids of forms (id, block, b) within a block, by similarity of a and b;
    of a block of over ENTITIES entities the two best of each part.

    Parts hold all forms of an entity, so the best two of a block are among those of its parts. A part's trie
    is built once for every NAMES names of its block. Forms and names must be free of nulls.
    """
    asked = names.groupBy("block").agg(F.count("*").alias("names")).select("block", F.ceil(F.col("names") / NAMES).cast("int").alias("slices"))
    held = forms.groupBy("block").agg(F.count_distinct("id").alias("ids")).select("block", F.ceil(F.col("ids") / ENTITIES).cast("int").alias("parts"))
    both = asked.join(held, "block")
    left = names.join(both, "block").withColumn("slice", F.pmod(F.xxhash64("raw"), F.col("slices"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = forms.join(both, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    keys = [F.col("block"), F.col("part").cast("int").alias("part"), F.col("slice").cast("int").alias("slice")]
    left, right = left.select(*keys, "raw", "a"), right.select(*keys, "id", "b")

    def search(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(asked) and len(held):
            trie = Trie(held["b"].tolist(), held["id"].tolist())
            for raw, a in zip(asked["raw"], asked["a"]):
                two, visited = trie.best_two(a)
                rows += [(raw, key[0], i, s, visited) for s, i in two]
        return pd.DataFrame(rows, columns=["raw", "block", "id", "score", "visited"])

    by = ["block", "part", "slice"]
    # a search takes long for few bytes, so that the number of tasks isn't left to the size of its input
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, FOUND)
