"""Spelling variants: pairs of a vocabulary's words at edit distance one, by a trie self-join.

Two words at distance one share all that lies before the edit and all that lies behind it, so the shorter
one's first half or last half is common to both. Words are therefore dealt by a prefix and by a suffix of
half their length; what remains of the words of one part is a trie, and active-node sets are propagated
down it: the nodes within distance one of a node follow from those of its parent. A part of more words
than a task is to hold is dealt again by halves of what remains, until it is small; what is left of a word
shortens each time, and two letters or fewer make no large part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import crc32_sql, small_batches, table

#: Words of a vocabulary: least code points and occurrences; how much commoner a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many occurrences, by hash, loses a letter.
EVERY = 199
#: Words in a part of the vocabulary that one task holds as a trie.
PART = 50_000
#: Different words that a task counts before it hands the counts on.
_HELD = 500_000

# every byte of Latin-1 text: letters of either case to lower-case A-Z or themselves, all else to a space
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


class _Counter:
    """Counts of words over the texts of a task, in arrays by the order in which words are met."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.size = np.zeros(1024, np.int32)
        self.crc = np.zeros(1024, np.uint32)
        self.n = np.zeros(1024, np.int64)
        self.words: list[str] = []
        self.short: dict[str, int] = {}

    def _number(self, raw: bytes) -> int:
        k = self.ids[raw] = len(self.words)
        word = raw.decode("latin-1")
        utf8 = word.encode()
        self.words.append(word)
        if k == len(self.n):
            self.size, self.crc, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.crc, self.n))
        self.size[k], self.crc[k] = len(utf8), crc32(utf8)
        return k

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw = (text or "").encode("latin-1", "replace").translate(_LETTERS).split()
        if not raw:
            return
        ids = self.ids
        at = np.fromiter((ids[w] if w in ids else self._number(w) for w in raw), np.int64, len(raw))
        if doc_id is None:
            np.add.at(self.n, at, 1)
            return
        # the CRC of two joined strings is the second's, and the first's carried over as many zero bytes
        start, sizes = crc32(b"%d:" % doc_id), self.size[at]
        carried = {s: crc32(bytes(s), start) ^ crc32(bytes(s)) for s in set(sizes.tolist())}
        carry = np.zeros(max(carried) + 1, np.uint32)
        carry[list(carried)] = list(carried.values())
        h = self.crc[at] ^ carry[sizes]
        hit = h % EVERY == 0
        np.add.at(self.n, at[~hit], 1)
        for k, x in zip(at[hit].tolist(), h[hit].tolist()):
            word = self.words[k]
            cut = x % len(word)
            word = word[:cut] + word[cut + 1 :]
            self.short[word] = self.short.get(word, 0) + 1

    def take(self) -> pa.RecordBatch:
        """What was counted, of words that are long enough; the counter starts anew."""
        rows = [(w, n) for w, n in zip(self.words, self.n.tolist()) if n and len(w) >= LEAST_LENGTH]
        rows += [(w, n) for w, n in self.short.items() if len(w) >= LEAST_LENGTH]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) that are long and frequent enough.

    Tasks count by themselves before the shuffle, so that a very common word is a row a task.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                c.add(doc_id, text)
                if len(c.words) + len(c.short) >= _HELD:
                    yield c.take()
        yield c.take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halves(rest, path):
    """The parts (path, rest) of a rest under a path: by its first and by its last half.

    Of two rests at distance one the shorter may be as long as this one or shorter by one; floor(s / 2)
    letters of the shorter's s are common at either end.
    """
    size = F.char_length(rest)
    sizes = F.array_distinct(F.array(F.floor(size / 2), F.floor((size - 1) / 2)))
    sizes = F.filter(sizes, lambda m: m >= 0)

    def part(m, side):
        m = m.cast("int")
        held = F.left(rest, m) if side == "f" else F.right(rest, m)
        left = F.substr(rest, m + 1) if side == "f" else F.left(rest, size - m)
        return F.struct(F.concat(path, F.lit(f"/{side}"), m.cast("string"), F.lit(":"), held).alias("path"), left.alias("rest"))

    return F.explode(F.concat(F.transform(sizes, lambda m: part(m, "f")), F.transform(F.filter(sizes, lambda m: m > 0), lambda m: part(m, "b"))))


def parts(words: DataFrame, size: int) -> DataFrame:
    """(path, rest, word, n) of words (word, n): parts of at most size words, unless all rests have two letters or fewer."""
    level = words.select("word", "n", _halves(F.col("word"), F.lit("")).alias("p")).select("p.path", "p.rest", "word", "n")
    done = None
    while True:
        level = table(level, "vocabulary-parts")
        counts = level.groupBy("path").agg(F.count("*").alias("rows"), F.max(F.char_length("rest")).alias("longest"))
        large = table(counts.where((F.col("rows") > size) & (F.col("longest") > 2)).select("path"), "large-parts")
        if large.isEmpty():
            return level if done is None else done.unionByName(level)
        small = level.join(large, "path", "left_anti")
        done = small if done is None else done.unionByName(small)
        level = level.join(large, "path", "left_semi")
        level = level.select("word", "n", _halves(F.col("rest"), F.col("path")).alias("p")).select("p.path", "p.rest", "word", "n")


def _steps(path: str) -> list[tuple[str, int]]:
    """The halves that a path takes: side and letters of each."""
    return [(step[0], int(step[1 : step.index(":")])) for step in path.split("/")[1:]]


def _own(steps: list[tuple[str, int]], a: str, b: str) -> bool:
    """Whether a pair is this path's: a pair that shares both halves is that of its first half, so that it is found once."""
    for side, m in steps:
        if m != min(len(a), len(b)) // 2 or (side == "f") != (a[:m] == b[:m]):
            return False
        a, b = (a[m:], b[m:]) if side == "f" else (a[: len(a) - m], b[: len(b) - m])
    return True


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ordered pairs (i, j) of different words at distance one.

    A node's active nodes are those within distance one; a child's are its parent, its siblings, its own
    children, and the children by its letter of its parent's active nodes.
    """
    kids: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word:
            nxt = kids[at].get(c)
            if nxt is None:
                nxt = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = nxt
        ends[at] = i
    todo = [(0, set(kids[0].values()))]
    while todo:
        node, active = todo.pop()
        i = ends[node]
        if i >= 0:
            for v in active:
                if ends[v] >= 0:
                    yield i, ends[v]
        own = kids[node]
        for c, child in own.items():
            near = {node, *own.values(), *kids[child].values()}
            for v in active:
                nxt = kids[v].get(c)
                if nxt is not None:
                    near.add(nxt)
            near.discard(child)
            todo.append((child, near))


def near_pairs(words: DataFrame, size: int = PART) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs, each once, of words (word, n; distinct) that differ by one
    inserted, deleted or replaced code point."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rests, held = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            steps = _steps(path)
            pairs = ((held[i], held[j]) for i, j in trie_pairs(rests) if _own(steps, held[i][0], held[j][0]))
            while some := list(islice(pairs, 20_000)):
                columns = zip(*[(*a, *b) for a, b in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], ["word", "n", "near", "near_n"])

        for b in batches:
            for p, rest, word, n in zip(*[b.column(c).to_pylist() for c in ("path", "rest", "word", "n")]):
                if p != path:
                    if len(rests) > 1:
                        yield from found()
                    path, rests, held = p, [], []
                rests.append(rest)
                held.append((word, n))
        if len(rests) > 1:
            yield from found()

    dealt = parts(words.select("word", "n"), size).repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(joined, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of the chain that starts at word, by doubling of steps."""
    steps = table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        ahead = table(ahead, "forms")
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        steps = ahead.select("word", "root")


def variants(docs: DataFrame, size: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text).

    A word is a run of Latin letters as the occurrences give it: A-Z in lower case, and one letter less
    where the hash of id and run says so. Words of at least LEAST_LENGTH code points and LEAST_COUNT
    occurrences count; a word's form is its commonest near word (ties: the first in code-point order) if
    that is at least TIMES as common.

    Null and empty texts hold no word. Runs of rows without an id lose no letter. Repeated rows count again. An
    empty table gives no rows; other columns are ignored.
    """
    words = table(vocabulary(docs), "vocabulary")
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    formed = near_pairs(words, size).unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    form = -F.col("best.less") >= TIMES * F.col("n")
    formed = formed.select("word", "n", "n_near", F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n"))
    formed = table(formed, "word-forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(name: str = "documents") -> str:
    """DuckDB SQL for variants: words that agree once a letter is left out at the same place, or one of which
    is the other less a letter."""
    h = crc32_sql("k")
    return f"""
        with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w from {name}),
        counted as (select doc_id, w, count(*) c, cast(doc_id as varchar) || ':' || w k from runs group by doc_id, w),
        hashed as (select w, c, {h} h from counted),
        met as (select case when h % {EVERY} = 0 then left(w, cast(h % length(w) as int)) || substr(w, cast(h % length(w) as int) + 2) else w end word, c from hashed),
        v as (select word, cast(sum(c) as bigint) n from met where length(word) >= {LEAST_LENGTH} group by word having sum(c) >= {LEAST_COUNT}),
        less as (select word, n, i, left(word, i) || substr(word, i + 2) y from (select *, unnest(range(0, length(word))) i from v)),
        near as (
            select a.word, b.word near, b.n near_n from less a join less b on a.y = b.y and a.i = b.i and a.word <> b.word
            union select a.word, v.word, v.n from less a join v on a.y = v.word
            union select v.word, a.word, a.n from less a join v on a.y = v.word),
        best as (select word, count(*) n_near, min(struct_pack(less := -near_n, near := near)) b from near group by word),
        f as (select v.word, v.n, coalesce(n_near, 0) n_near, case when -b.less >= {TIMES} * v.n then b.near end form, case when -b.less >= {TIMES} * v.n then -b.less end form_n from v left join best using (word)),
        chain as (select word, word tip from f union all select c.word, f.form from chain c join f on f.word = c.tip where f.form is not null)
        select f.word, f.form, c.tip root, f.n, f.n_near, f.form_n from f join chain c using (word) join f e on e.word = c.tip where e.form is null"""
