"""Runs of repeated words: maximal periodic stretches of a text, by its suffix automaton.

The automaton's states are the text's factors by the places where they end. From long states to short ones
these sets of end positions are merged along suffix links, the smaller into the larger. Where a position
meets a new neighbour in a state at a distance of at most the state's length, the words up to both agree
over that distance: a square. A run of period q holds such a pair for distance q, as the longest factor that
ends both at its end and q words before it has no occurrence between. Squares are extended to runs.

Before that, words that can lie in no run are cut off. With at least LEAST words and TIMES periods, every
four words that follow each other in a run occur once more in it, at the distance of its period, which is no
more than a quarter of the stretch. So only stretches whose every four words recur that near, within the
stretch, get an automaton. The cuts are repeated until none is made; they lose no run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from hashlib import sha256
from itertools import pairwise
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import crc32_sql, small_batches

#: Least words and least periods of a run; words of a gram, of which a run holds each twice.
LEAST, TIMES, _GRAM = 6, 4, 4
_ODD = np.random.default_rng(4).integers(1 << 62, size=_GRAM, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Positions in a block of an ordered set.
_BLOCK = 2048


class _Ends:
    """An ordered set of positions in blocks, so that insertion moves one block at most."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Adds x, which isn't in it, and returns its neighbours."""
        blocks = self.blocks
        k = 0 if len(blocks) == 1 else bisect_left(blocks, x, key=lambda b: b[-1])
        k = min(k, len(blocks) - 1)
        b = blocks[k]
        at = bisect_left(b, x)
        before = b[at - 1] if at else blocks[k - 1][-1] if k else None
        after = b[at] if at < len(b) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        b.insert(at, x)
        self.size += 1
        if len(b) > _BLOCK:
            blocks[k : k + 1] = [b[: _BLOCK // 2], b[_BLOCK // 2 :]]
        return before, after


def automaton(w: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of w: each state's suffix link, its longest length, and where it ends first if no clone, else -1."""
    nxt: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        cur = len(nxt)
        nxt.append({})
        length.append(i + 1)
        link.append(0)
        end.append(i)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return link, length, end


def squares(w: list[int]):
    """(x, d): the d words up to word x equal the d before them; for every run of two periods d or more at least one."""
    link, length, end = automaton(w)
    ends: list[_Ends | None] = [_Ends(e) if e >= 0 else None for e in end]
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        p = link[v]
        mine, ends[v] = ends[v], None
        if p <= 0 or mine is None:
            continue
        theirs = ends[p]
        if theirs is None:
            ends[p] = mine
            continue
        if theirs.size < mine.size:
            mine, theirs = theirs, mine
        most = length[p]
        for x in mine:
            before, after = theirs.insert(x)
            if before is not None and x - before <= most:
                yield x, x - before
            if after is not None and after - x <= most:
                yield after, after - x
        ends[p] = theirs


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of w, by start and period; the period is the smallest."""
    found: dict[int, list[tuple[int, int]]] = {}
    for x, d in squares(w):
        spans = found.setdefault(d, [])
        k = bisect_left(spans, (x + 1,))
        # spans are kept by their ends, the word behind the last; the one that ends at x + 1 or later may hold this square
        if k < len(spans) and spans[k][1] <= x + 1 - 2 * d:
            continue
        a, b = x - d, x + 1
        while a > d - 1 and w[a] == w[a - d]:
            a -= 1
        while b < len(w) and w[b] == w[b - d]:
            b += 1
        insort(spans, (b, a - d + 1))
    least: dict[tuple[int, int], int] = {}
    for d, spans in found.items():
        for b, a in spans:
            if b - a >= max(LEAST, TIMES * d):
                least[a, b] = min(d, least.get((a, b), d))
    return sorted((a, b - a, d) for (a, b), d in least.items())


def stretches(w: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches of w, the words of texts of these sizes on end, that may hold runs."""
    n = len(w) - _GRAM + 1
    if n <= 0:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(_GRAM):
        h = (h ^ (h >> np.uint64(29))) * _ODD[k] + w[k : k + n].astype(np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.flatnonzero(of[:n] == of[_GRAM - 1 :])
    order = place[np.argsort(h[place], kind="stable")]
    stretch, size = of, sizes
    while len(order):
        same = (h[order[1:]] == h[order[:-1]]) & (stretch[order[1:]] == stretch[order[:-1]])
        near = same & (np.diff(order) * TIMES <= size[stretch[order[1:]]])
        held = np.zeros(n, bool)
        held[order[np.r_[near, False] | np.r_[False, near]]] = True
        # a stretch is a series of grams that all stay, in one text
        first = np.flatnonzero(held & ~np.r_[False, held[:-1] & (stretch[1:n] == stretch[: n - 1])])
        last = np.flatnonzero(held & ~np.r_[held[1:] & (stretch[1:n] == stretch[: n - 1]), False])
        long = last - first + _GRAM >= LEAST
        first, last = first[long], last[long]
        size = last - first + _GRAM
        stretch = np.full(len(w), -1)
        inner = np.repeat(first - np.r_[0, np.cumsum(last - first + 1)[:-1]], last - first + 1) + np.arange((last - first + 1).sum())
        stretch[inner] = np.repeat(np.arange(len(first)), last - first + 1)
        kept = order[stretch[order] >= 0]
        if len(kept) == len(order):
            return [(a, b + _GRAM) for a, b in zip(first.tolist(), last.tolist())]
        order = kept
    return []


def looped(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on become those of a to a + p, over and over; by the id's hash."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(crc32(b"%d" % doc_id), 10)
    a = g % n
    return None if rest else (a, 1 + (n - a) // (3 + g % 8))


def _judge(ids: list, texts: list[str | None]) -> list[tuple]:
    numbers: dict[bytes, int] = {}
    words, arrays = [], []
    for k, t in zip(ids, texts):
        # bytes.split() splits at the six ASCII spaces only
        x = (t or "").encode("utf-8", "surrogatepass").split()
        loop = looped(k, len(x))
        if loop:
            a, p = loop
            x = x[:a] + (x[a : a + p] * (-(-(len(x) - a) // p)))[: len(x) - a]
        words.append(x)
        arrays.append(np.fromiter((numbers.setdefault(y, len(numbers)) for y in x), np.int64, len(x)))
    sizes = np.array([len(x) for x in words], np.int64)
    w = np.concatenate([np.zeros(0, np.int64), *arrays])
    start = np.r_[0, np.cumsum(sizes)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for a, b in stretches(w, sizes):
        k = int(np.searchsorted(start, a, "right")) - 1
        found[k] += [(a - int(start[k]) + s, n, q) for s, n, q in runs(w[a:b].tolist())]
    out = []
    for x, rs in zip(words, found):
        best = None
        for s, n, q in rs:
            # first of the greatest n / q, as rs goes by start and period
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        rs.sort()
        drop = np.zeros(len(x) + 1, np.int64)
        for s, n, q in rs:
            drop[s + q] += 1
            drop[s + n] -= 1
        drop = np.cumsum(drop[:-1]) > 0
        kept = [y for y, d in zip(x, drop.tolist()) if not d] if rs else x
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(rs, key=lambda r: (r[0], r[2])))
        head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        collapsed = b" ".join(kept)
        out.append((len(rs), *head, sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest(), listed, collapsed.decode("utf-8", "surrogatepass")))
    return out


#: Words that are looked at together, about; longer texts come alone.
_TOGETHER = 500_000


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_runs, the greatest run's start, length, period and exponent_milli,
    runs_sha256, collapsed_sha256, and runs (`start,length,period` lines) and collapsed, the text without repetition.

    Words are what stands between ASCII white space. Texts of one in ten ids, by hash, are made periodic first
    (looped()); those of null ids aren't. A run is at least LEAST words and TIMES periods long. Null and empty
    texts have no words and no run: n_runs 0, four nulls, hashes of nothing. Repeated rows are rows of their
    own; an empty table gives no rows; other columns are ignored. A text is one task's work, whatever its length.
    """
    small_batches(docs.sparkSession)
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]

    @F.pandas_udf("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs string, collapsed string")
    def judge(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        ids, texts = [None if k is None else int(k) for k in ids], list(texts)
        size = np.cumsum([len(t or "") for t in texts]) // (6 * _TOGETHER)
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        rows = [r for a, b in pairwise(cuts) for r in _judge(ids[a:b], texts[a:b])]
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        for c in columns[:5]:
            out[c] = out[c].astype("Int64")
        return out

    # as text, an id is no float beside nulls
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", judge(F.col("doc_id").cast("string"), "text").alias("r")).select("doc_id", "r.*")


def sql(name: str = "documents") -> str:
    """DuckDB SQL for periodic_runs but runs and collapsed: for each period q, a run holds three multiples of q
    that follow each other at which the words q apart agree; these few (text, q) are looked at in full."""
    return f"""
        with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w0, {crc32_sql("cast(doc_id as varchar)")} h from {name}),
        g as (select *, len(w0) n, h // 10 g, case when h % 10 = 0 and len(w0) > 0 then (h // 10) % len(w0) end a from d),
        p as (select *, 1 + (n - a) // (3 + g % 8) p from g),
        l as (select rid, doc_id, n, case when a is null then w0 else list_transform(range(n), lambda i: w0[1 + case when i < a then i else a + (i - a) % p end]) end w from p),
        q as (select rid, w, n, unnest(range(1, n // {TIMES} + 1)) q from l where n >= {LEAST}),
        m as (select rid, q, i from (select rid, w, q, unnest(range(q, n - 2 * q + 1, q)) i from q) where w[i] = w[i + q] and (i + 2 * q > len(w) or w[i + q] = w[i + 2 * q])),
        c as (select distinct rid, q from m),
        e as (select rid, q, i - row_number() over (partition by rid, q order by i) k, i from (select rid, q, w, unnest(range(1, n - q + 1)) i from c join l using (rid)) where w[i] = w[i + q]),
        s as (select rid, q, min(i) - 1 s, count(*) + q len from e group by rid, q, k having count(*) + q >= greatest({LEAST}, {TIMES} * q)),
        r as (select rid, s, len, min(q) q from s group by rid, s, len),
        t as (select rid, count(*) n_runs, max_by(struct_pack(s := s, len := len, q := q), struct_pack(x := len / q, y := -s, z := -q)) b, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) runs,
              flatten(list(range(s + q, s + len))) gone from r group by rid)
        select doc_id, coalesce(n_runs, 0) n_runs, b.s as start, cast(b.len as bigint) as length, cast(b.q as bigint) as period, cast(1000 * b.len // b.q as bigint) exponent_milli, sha256(coalesce(runs, '')) runs_sha256,
            sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(n), lambda i: not list_contains(gone, i)), lambda i: w[i + 1]) end, ' ')) collapsed_sha256
        from l left join t using (rid)"""
