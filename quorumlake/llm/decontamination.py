"""Benchmark decontamination by the q-gram lemma.

A document region within k edits of an item of m characters shares m + 1 - q - k q of the item's
q-grams with it, on diagonals at most k apart. Shared q-grams are counted in overlapping bands of
diagonals, bands that meet the bound are retained, and a banded alignment verifies them. Items without
a q-gram, under Q characters, are found as whole words instead.

The benchmark is the stated query set: it is scanned in blocks of MAX_ITEM_CHARS characters, one pass
over the documents for each. A block is read, broadcast, used and released before the next is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import fresh, small_batches, table, text_hash

Q, EDITS = 10, 0.08
#: Characters of benchmark items that one pass over the documents takes; an index of them has about 27 bytes a character.
MAX_ITEM_CHARS = 2_000_000
_MASK_BITS = 22
# a word, or a lone character that is none
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]")


def normal(text: str | None) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q characters."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = x.astype(np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    four = (two[:-2] ^ (two[:-2] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + two[2:]
    eight = (four[:-4] ^ (four[:-4] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + four[4:]
    ten = (eight[:n] ^ (eight[:n] >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93) + two[8 : 8 + n]
    return ten ^ (ten >> np.uint64(32))


def budget(m: int) -> int:
    """Edits allowed: EDITS of the item's length, but no more than leave one q-gram to count."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def align(item: np.ndarray, region: np.ndarray, most: int, first: int, last: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the region's part nearest to item, if within most edits.

    Only diagonals first to last (region place less item place) are filled, row by row; a part may
    start and end anywhere in the band. Start is found by aligning backwards from the end.
    """

    def run(a: np.ndarray, b: np.ndarray, lo: int, hi: int, free: bool) -> tuple[np.ndarray, int]:
        wide = hi - lo + 1
        far = most + 1
        at = np.arange(lo, hi + 1)
        row = np.where((at >= 0) & (at <= len(b)), 0 if free else np.abs(at), far).astype(np.int64)
        ramp = np.arange(wide)
        up = np.empty(wide, np.int64)
        for i, c in enumerate(a, 1):
            at = at + 1
            ok = (at >= 1) & (at <= len(b))
            same = np.zeros(wide, bool)
            same[ok] = b[at[ok] - 1] == c
            new = np.where(ok, row + ~same, far)
            up[:-1], up[-1] = row[1:], far
            up += 1
            new = np.minimum(new, np.where((at >= 0) & (at <= len(b)), up, far))
            # insertions run along the row
            new = np.minimum.accumulate(new - ramp) + ramp
            row = np.minimum(np.where((at >= 0) & (at <= len(b)), new, far), far)
            if row.min() > most:
                return row, i
        return row, len(a)

    at = region.tobytes().find(item.tobytes())
    if at >= 0 and at % item.itemsize == 0 and first <= at // item.itemsize <= last:
        return 0, at // item.itemsize, at // item.itemsize + len(item)
    row, rows = run(item, region, first, last, True)
    if rows < len(item) or row.min() > most:
        return None
    edits = int(row.min())
    end = int(np.flatnonzero(row == edits)[0]) + first + len(item)
    back, rows = run(item[::-1], region[:end][::-1], -edits, edits, False)
    start = end - (int(np.flatnonzero(back == back.min())[0]) - edits + len(item))
    return edits, max(0, start), end


@dataclass
class Index:
    """q-grams of the items, sorted by hash, with their item and place, a bitmap of the hashes, and the short items by text."""

    ids: np.ndarray
    items: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    short: dict[str, list[int]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Index:
        own = [normal(t) for t in texts]
        ids, items = np.array(ids, np.int64), [codes(t) for t in own]
        short: dict[str, list[int]] = {}
        for k, t in enumerate(own):
            if 0 < len(t) < Q:
                short.setdefault(t, []).append(k)
        each = [qgrams(x) for x in items]
        grams = np.concatenate([np.zeros(0, np.uint64), *each])
        item = np.repeat(np.arange(len(items)), [len(x) for x in each])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in each]])
        order = np.argsort(grams, kind="stable")
        bitmap = np.zeros(1 << _MASK_BITS, bool)
        bitmap[grams >> np.uint64(64 - _MASK_BITS)] = True
        size = np.array([len(x) for x in items], np.int64)
        edits = np.array([budget(len(x)) for x in items], np.int64)
        return cls(ids, items, grams[order], item[order], place[order], bitmap, size, edits, size + 1 - Q - edits * Q, short)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) in the normalised text, one for each region and item."""
        text = normal(text)
        return self._words(text) + self._regions(codes(text))

    def _words(self, text: str) -> list[tuple[int, int, int, int]]:
        """Matches of the items under Q characters: whole words, or runs of them, of the text."""
        if not self.short:
            return []
        out, starts, ends = [], [], []
        for m in _WORD.finditer(text):
            starts.append(m.start())
            ends.append(m.end())
        for a, s in enumerate(starts):
            for e in ends[a : a + Q]:
                if e - s >= Q:
                    break
                out += [(k, s, e, 0) for k in self.short.get(text[s:e], ())]
        return out

    def _regions(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(self.grams):
            return []
        g = qgrams(x)
        at = np.flatnonzero(self.bitmap[g >> np.uint64(64 - _MASK_BITS)])
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.grams, g[at], "left"), np.searchsorted(self.grams, g[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[entry]
        # an item with too few shared q-grams in the whole text has no band that meets the bound
        enough = (np.bincount(item, minlength=len(self.items)) >= self.least)[item]
        if not enough.any():
            return []
        entry, item, where = entry[enough], item[enough], np.repeat(at, n)[enough]
        # bands are 2 k + 2 wide and start every k + 1: any k + 1 diagonals lie in one of them
        band = np.floor_divide(where - self.place[entry], self.edits[item] + 1) + (1 << 30)
        # a q-gram of the item counts once in a band, wherever it recurs there
        pair = np.unique(np.concatenate([(entry << 32) + band, (entry << 32) + band - 1]))
        key = (self.item[pair >> 32] << 32) + (pair & 0xFFFFFFFF)
        bands, count = np.unique(key, return_counts=True)
        kind = bands >> 32
        held = count >= self.least[kind]
        out, size, edits = [], self.size, self.edits
        last: dict[int, tuple[int, int]] = {}
        for b, k in zip(bands[held], kind[held]):
            k, low = int(k), (int(b & 0xFFFFFFFF) - (1 << 30)) * (int(edits[int(k)]) + 1)
            high = low + 2 * int(edits[k]) + 1
            if k in last and low <= last[k][1]:
                last[k] = (last[k][0], high)
            else:
                if k in last:
                    out.append((k, *last[k]))
                last[k] = (low, high)
        out += [(k, *v) for k, v in last.items()]
        found = []
        for k, low, high in out:
            e = int(edits[k])
            from_ = max(0, low - e)
            region = x[from_ : high + size[k] + e]
            if (hit := align(self.items[k], region, e, low - e - from_, high + e - from_)) is not None:
                found.append((k, from_ + hit[1], from_ + hit[2], hit[0]))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The items in blocks, each made as it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    ids, texts, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if size >= MAX_ITEM_CHARS:
            yield Index.of(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    yield Index.of(ids, texts)


_MATCH = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def _several(benchmark: DataFrame) -> bool:
    """Whether the items may take more than one block."""
    return (benchmark.agg(F.sum(F.char_length(F.col("text").cast("string")))).first()[0] or 0) > MAX_ITEM_CHARS


def _matcher(spark, index: Index):
    """A column of matches of the column text, and the broadcast index that it needs."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(_MATCH)
    def of(texts: pd.Series) -> pd.Series:
        names = ("item_id", "start", "end", "edits")
        return pd.Series([[dict(zip(names, (int(shared.value.ids[k]), *rest))) for k, *rest in shared.value.matches(t)] for t in texts])

    return of(F.col("text").cast("string")), shared


def _in_blocks(rows: DataFrame, benchmark: DataFrame, made, name: str) -> list[DataFrame]:
    """made(rows, matches) for each block of the benchmark; where there are several, each is written."""
    spark = rows.sparkSession
    if not _several(benchmark):
        return [made(rows, _matcher(spark, next(_blocks(benchmark)))[0])]
    out = []
    for index in _blocks(benchmark):
        found, shared = _matcher(spark, index)
        out.append(table(made(rows, found), name))
        shared.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per match: doc_id, item_id, start, end (in the normalised text), edits.

    A null or empty text matches nothing, nor does an item that is null or has no character but white
    space. An item under Q characters matches where it stands as a whole word or words. Repeated rows
    give repeated matches, items of equal text one each. Without documents or items the result is empty;
    columns other than doc_id, item_id and text are ignored.
    """
    made = lambda rows, found: rows.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
    return reduce(DataFrame.unionByName, _in_blocks(docs.select("doc_id", "text"), benchmark, made, "matches"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no item matches."""
    if not _several(benchmark):
        hits = fresh(docs.columns, "benchmark_hits")
        found, _ = _matcher(docs.sparkSession, next(_blocks(benchmark)))
        return docs.withColumn(hits, F.size(F.coalesce(found, F.array().cast(_MATCH)))).where(F.col(hits) == 0).drop(hits)
    # equal texts share their fate, so that a text's hashes tell what goes
    h = lambda: (text_hash(), F.sha2(F.col("text").cast("string"), 256))
    made = lambda rows, found: rows.where(F.size(found) > 0).select(*[x.alias(c) for x, c in zip(h(), "ab")]).distinct()
    gone = reduce(DataFrame.unionByName, _in_blocks(docs.select("text"), benchmark, made, "leaks")).distinct()
    a, b = fresh(docs.columns, "text_a"), fresh(docs.columns, "text_b")
    rows = docs.withColumn(a, h()[0]).withColumn(b, h()[1])
    gone = gone.select(F.col("a").alias(a), F.col("b").alias(b))
    return rows.join(gone, [a, b], "left_anti").select(*docs.columns)
