"""Removal of long repeated byte strings through a logarithmic family of suffix arrays.

A batch of documents becomes a suffix array: a table of suffixes in byte order, that of their first
eight bytes, and of equal ones by a 64-bit hash of GRAM bytes. Only suffixes that start with the
least-hashed GRAM-byte string of some window of LENGTH bytes are in it (two in GRAM-window sizes, instead
of all): equal windows have the same such string at the same place, so no repeat is lost. Each entry
stands for the run of windows that chose it.

A new batch is sorted by itself, and of equal runs one is kept. It is then merge-scanned with each existing level: a level
lies in files by ranges of suffixes, with known bounds, and only the batch is dealt to these ranges; a task looks the
batch's suffixes up among its range's, which are in order, and nothing of the level moves. Entries with equal runs are
repeats at once; where suffixes agree in GRAM bytes and the runs differ, the windows of each different run
are compared. A prefix may go over the edges of ranges; where the batch has it, all ranges that it spans are asked.
Levels of equal rank then merge into one of the next rank: the younger is dealt to the older's ranges, and those that
have become large are cut. A family of n batches has at most log2(n) + 1 levels and moves each entry as often.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import drop_table, scratch, small_batches, table, text_hash

LENGTH, GRAM = 400, 128
_WINDOW = LENGTH - GRAM + 1
_CHUNK = 1 << 23
_ODD = np.random.default_rng(1).integers(1 << 62, size=8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(2).integers(1 << 62, size=256, dtype=np.int64).astype(np.uint64)
#: Windows that a task compares at once; a single prefix may exceed it.
_AT_ONCE = 500_000


def hashes(x: np.ndarray, doublings: int = 7) -> np.ndarray:
    """A 64-bit hash of the 2**doublings bytes from each place on."""
    h = _BYTE[x]
    for k in range(doublings):
        a, b = h[: -(1 << k)], h[1 << k :]
        h = a ^ (a >> np.uint64(29))
        h *= _ODD[k]
        h += b
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each run of width values is, the leftmost if tied."""
    n = len(h) - width + 1
    packed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(h) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = packed
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def entries(raw: bytes) -> np.ndarray:
    """(rows, 4): first bytes in byte order, prefix hash, hash of the run's bytes, its windows.

    Windows are first << 32 | last, by where they start.
    """
    out = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), _CHUNK):
        x = np.frombuffer(raw, np.uint8)[at : at + _CHUNK + LENGTH - 1]
        h = hashes(x)
        chosen = _least(h, _WINDOW)
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        last = np.r_[first[1:] - 1, len(chosen) - 1]
        a, b = np.full(len(first), 7, np.uint64), np.full(len(first), 11, np.uint64)
        for k in range(0, LENGTH + _WINDOW, GRAM):
            part = h[np.minimum(first + k, last + LENGTH - GRAM)]
            a = (a ^ (a >> np.uint64(31))) * _ODD[0] + part
            b = (b ^ (b >> np.uint64(27))) * _ODD[1] + (part ^ (part >> np.uint64(33)))
        # runs of different length are different even where their blocks agree
        a = (a ^ (a >> np.uint64(29))) * _ODD[2] + b + (last - first).astype(np.uint64)
        place = chosen[first]
        lead = np.zeros(len(first), np.uint64)
        for k in range(8):
            lead = (lead << np.uint64(8)) | x[place + k].astype(np.uint64)
        # signed order of the flipped number is byte order
        lead ^= np.uint64(1 << 63)
        out.append(np.stack([lead.view(np.int64), h[place].view(np.int64), a.view(np.int64), (first + at) << 32 | (last + at)], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.r_[False, k[1:] == k[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = same | np.r_[same[1:], False]
    return out


def _utf8(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]



#: A suffix array's columns.
ENTRY = ("lead", "gram", "run", "doc_id", "th", "windows")


def suffixes(docs: DataFrame) -> DataFrame:
    """The entries, ENTRY, of docs (doc_id, th, text), in no order yet."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [entries((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            own = pa.array(np.repeat(np.arange(len(texts)), [len(e) for e in texts]))
            e = np.concatenate(texts) if texts else np.zeros((0, 4), np.int64)
            lead, gram, run, windows = (pa.array(np.ascontiguousarray(c)) for c in e.T)
            out = pa.RecordBatch.from_arrays([lead, gram, run, b.column("doc_id").take(own), b.column("th").take(own), windows], list(ENTRY))
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    return docs.select("doc_id", "th", "text").mapInArrow(of, ", ".join(f"{c} long" for c in ENTRY))


#: Entries in a range, about: what a task that scans holds at once; parts that a range is cut into when levels merge, at most.
RANGE, CUTS = 250_000, 4
#: Ranges of a level, at most, so that its bounds (24 bytes each) can be broadcast; beyond that, ranges grow.
MOST_RANGES = 1 << 20
#: Runs of one prefix that a task compares by itself; the windows of more common prefixes are spread.
COMMON = 10_000
#: What tells runs apart, and what a scan says of an entry: `again`, its run occurs again; `stands`, it is to be compared with other runs of its prefix.
RUN = ("lead", "gram", "run")
_FLAGGED = "lead long, gram long, run long, doc_id long, th long, windows long, again boolean, stands boolean"
_STORED = "lead long, gram long, run long, doc_id long, th long, windows long, range long"


def _columns(t: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in names]


def ranks(held: list[np.ndarray], keys: list[np.ndarray], right: bool) -> np.ndarray:
    """How many of held, rows in order by their columns, come before each key; with right, or equal it."""
    low, high = np.searchsorted(held[0], keys[0]), np.searchsorted(held[0], keys[0], "right")
    out = high.copy() if right and len(held) == 1 else low
    if len(held) > 1:
        # few first columns are alike; only there do the next ones decide
        for k in np.flatnonzero(high > low):
            i, j = low[k], high[k]
            out[k] = i + ranks([x[i:j] for x in held[1:]], [x[k : k + 1] for x in keys[1:]], right)[0]
    return out


def batch_scan(entries: DataFrame, rows: int) -> DataFrame:
    """entries (ENTRY) in ranges of suffixes, each in order, with range, again, stands and kept, by a scan of neighbours.

    kept: the first of its run in its range. A prefix at the edge of a range may have other runs beyond it, so its runs
    stand.
    """
    n = min(rows // RANGE + 1, MOST_RANGES)
    dealt = entries.select(*ENTRY).repartitionByRange(n, *ENTRY).withColumn("range", F.spark_partition_id().cast("long")).sortWithinPartitions(*ENTRY)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        lead, gram, run = _columns(t, RUN)
        new = np.r_[True, (gram[1:] != gram[:-1]) | (lead[1:] != lead[:-1])]
        other = new | np.r_[True, run[1:] != run[:-1]]
        at, runs_at = np.flatnonzero(new), np.flatnonzero(other)
        group = np.cumsum(new) - 1
        runs = np.add.reduceat(other.astype(np.int64), at)
        edge = np.zeros(len(at), bool)
        edge[[0, -1]] = True
        again = (np.diff(np.r_[runs_at, len(run)]) > 1)[np.cumsum(other) - 1]
        for name, flag in (("again", again), ("stands", other & ((runs > 1) | edge)[group]), ("kept", other)):
            t = t.append_column(name, pa.array(flag))
        yield from t.to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(walk, _STORED + ", again boolean, stands boolean, kept boolean")


class Stored:
    """Entries in ranges, as a table in buckets by range, so that a range is met without being moved.

    bounds are each range's least (lead, gram, run), in order, and ids the ranges' numbers.
    """

    def __init__(self, rows: DataFrame, ranges: int, name: str):
        spark = rows.sparkSession
        self.path, self.name = scratch(spark, name), f"quorumlake_{name.replace('-', '_')}_{uuid.uuid4().hex}"
        rows.write.bucketBy(max(1, min(ranges, MOST_BUCKETS)), "range").sortBy("range", *RUN).option("path", self.path).saveAsTable(self.name)
        self.table = spark.table(self.name)
        kept = self.kept()
        least = kept.groupBy("range").agg(F.min(F.struct(*RUN)).alias("m"), F.count("*").alias("n")).select("m.*", "range", "n")
        # at most MOST_RANGES rows
        found = least.toPandas().sort_values(["lead", "gram", "run", "range"], ignore_index=True)
        self.bounds = [found[c].to_numpy(np.int64) for c in RUN]
        self.ids, self.rows = found["range"].to_numpy(np.int64), int(found["n"].sum())

    def kept(self) -> DataFrame:
        return self.table.where("kept") if "kept" in self.table.columns else self.table

    def drop(self) -> None:
        drop_table(self.table)
        self.table.sparkSession.sql(f"drop table if exists {self.name}")


#: Buckets of a table, within what Spark allows; ranges share them beyond that.
MOST_BUCKETS = 50_000


def _dealt(rows: DataFrame, level: Stored) -> DataFrame:
    """rows (ENTRY) with the range of a level that holds their run if it has it, the last one that starts with it or before."""
    shared = rows.sparkSession.sparkContext.broadcast((level.bounds, level.ids))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, ids = shared.value
        for b in batches:
            t = pa.Table.from_batches([b])
            at = np.maximum(ranks(bounds, _columns(t, RUN), True) - 1, 0)
            yield from t.append_column("range", pa.array(ids[at])).to_batches()

    return rows.select(*ENTRY).mapInArrow(deal, _STORED)


def _asked_beyond(rows: DataFrame, level: Stored) -> DataFrame:
    """Rows without an entry for the ranges that a prefix of rows spans in a level, one a prefix and range."""
    shared = rows.sparkSession.sparkContext.broadcast((level.bounds[:2], level.ids))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, ids = shared.value
        for b in batches:
            keys = _columns(pa.Table.from_batches([b]), RUN[:2])
            first, last = ranks(bounds, keys, False), ranks(bounds, keys, True)
            more = np.flatnonzero(last > first)
            if not len(more):
                continue
            start = np.maximum(first[more] - 1, 0)
            count = last[more] - start
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            own = np.repeat(more, count)
            zero = pa.array(np.zeros(len(at), np.int64))
            columns = [pa.array(keys[0][own]), pa.array(keys[1][own]), zero, zero, zero, pa.array(np.full(len(at), -1)), pa.array(ids[at])]
            yield pa.RecordBatch.from_arrays(columns, [*ENTRY, "range"])

    return rows.select(*RUN[:2]).distinct().mapInArrow(spans, _STORED).distinct()


def _in_order(t: pa.Table) -> pa.Table:
    """t by run; a range's file is in order, and is sorted only where Spark has read it in another one."""
    if t.num_rows < 2:
        return t
    lead, gram, run = _columns(t, RUN)
    ahead = (lead[1:] > lead[:-1]) | ((lead[1:] == lead[:-1]) & ((gram[1:] > gram[:-1]) | ((gram[1:] == gram[:-1]) & (run[1:] >= run[:-1]))))
    return t if ahead.all() else t.take(pa.array(np.lexsort((run, gram, lead))))


def merge_scan(level: Stored, batch: DataFrame) -> DataFrame:
    """_FLAGGED: what batch (ENTRY, each run once a range of its own) and a level have in common, on both sides."""
    shared = batch.sparkSession.sparkContext.broadcast((level.bounds, level.ids))
    right = _dealt(batch, level).unionByName(_asked_beyond(batch, level))
    fields = pa.schema([(c, pa.int64()) for c in ENTRY] + [("again", pa.bool_()), ("stands", pa.bool_())])

    def scan(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return fields.empty_table()
        bounds, ids = shared.value
        held = _in_order(held.select(ENTRY))
        have, keys = _columns(held, RUN), _columns(asked, RUN)
        real = asked["windows"].to_numpy() >= 0
        low, high = ranks(have[:2], keys[:2], False), ranks(have[:2], keys[:2], True)
        first, last = ranks(have, keys, False), ranks(have, keys, True)
        same = real & (last > first)
        # the prefix may go on beyond this range if a range starts with it
        edge = ranks(bounds[:2], keys[:2], True) > ranks(bounds[:2], keys[:2], False)
        differ = (high - low > last - first) | ~real | edge
        steps = np.zeros((2, held.num_rows + 1), np.int64)
        for k, (i, j, which) in enumerate(((first, last, same), (low, high, differ))):
            np.add.at(steps[k], i[which], 1)
            np.add.at(steps[k], j[which], -1)
        again, stands = np.cumsum(steps, axis=1)[:, :-1] > 0
        out = []
        for t, a, x in ((held, again, stands), (asked.select(ENTRY), same, differ & real)):
            some = np.flatnonzero(a | x)
            if len(some):
                out.append(t.take(pa.array(some)).append_column("again", pa.array(a[some])).append_column("stands", pa.array(x[some])).cast(fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    return level.kept().select(*ENTRY, "range").groupBy("range").cogroup(right.groupBy("range")).applyInArrow(scan, _FLAGGED)


def merge(level: Stored, younger: Stored) -> Stored:
    """A level of both: the younger's entries go to the older's ranges, of equal runs the older's stay, and large ranges are cut."""
    right = _dealt(younger.kept(), level)
    fields = pa.schema([(c, pa.int64()) for c in (*ENTRY, "range")])

    def join(key: tuple, held: pa.Table, more: pa.Table) -> pa.Table:
        held, more = _in_order(held.select(ENTRY)), _in_order(more.select(ENTRY))
        have, keys = _columns(held, RUN), _columns(more, RUN)
        first, last = ranks(have, keys, False), ranks(have, keys, True)
        fresh = np.flatnonzero((last == first) & np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)][: more.num_rows])
        # the places of both in the merged order: each after what comes before it on the other side
        place = np.empty(held.num_rows + len(fresh), np.int64)
        mine = last[fresh] + np.arange(len(fresh))
        taken = np.zeros(len(place), bool)
        taken[mine] = True
        place[mine] = held.num_rows + np.arange(len(fresh))
        place[~taken] = np.arange(held.num_rows)
        t = pa.concat_tables([held, more.take(pa.array(fresh))]).take(pa.array(place))
        parts = min(CUTS, -(-len(place) // RANGE))
        number = int(key[0].as_py()) * CUTS + np.arange(len(place)) * parts // max(1, len(place))
        return t.append_column("range", pa.array(number)).cast(fields)

    both = level.kept().select(*ENTRY, "range").groupBy("range").cogroup(right.groupBy("range")).applyInArrow(join, _STORED)
    n = (level.rows + younger.rows) // RANGE + 1
    return Stored(both, n, "suffix-array")


#: Bits of a filter on documents, whatever their number, and the keys up to which it is of use.
FILTER_BITS, FILTER_KEYS = 1 << 26, 1 << 23
_CHUNK_BITS = 1 << 15


def _slot():
    return F.pmod(F.xxhash64("doc_id", "th"), F.lit(FILTER_BITS))


def maybe_in(docs: DataFrame, keys: DataFrame):
    """A boolean column of docs (doc_id, th): false only for documents that keys (doc_id, th) lack.

    It saves shuffling texts that a join would drop. The bitmap has FILTER_BITS bits however many keys
    there are; for more than FILTER_KEYS it would pass nearly all, so all pass and the join alone decides.
    """
    if keys.count() > FILTER_KEYS:
        return F.lit(True)

    def chunk(key: tuple, slots: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_CHUNK_BITS, np.uint8)
        bits[slots["slot"].to_numpy(np.int64) % _CHUNK_BITS] = 1
        return pd.DataFrame({"k": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    slots = keys.select(_slot().alias("slot")).distinct().withColumn("k", F.floor(F.col("slot") / _CHUNK_BITS))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in slots.groupBy("k").applyInPandas(chunk, "k long, bits binary").collect():
        bitmap[r["k"] * _CHUNK_BITS // 8 : (r["k"] + 1) * _CHUNK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return held(_slot())


def compared(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, th, s, e): byte ranges of equal windows of runs (gram, doc_id, th, windows) of docs (doc_id, th, text).

    Prefixes are counted over all runs that are compared; those of more than COMMON are spread.
    """
    runs = table(runs.distinct(), "runs-to-compare")
    common = runs.groupBy("gram").count().where(F.col("count") > COMMON).select("gram", F.lit(True).alias("common"))
    runs = runs.join(common, "gram", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    per_doc = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("gram", "common", "windows")).alias("w"))
    per_doc = table(per_doc, "runs-by-document")

    @F.pandas_udf("array<binary>")
    def regions(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([[x[w["windows"] >> 32 : (w["windows"] & 0xFFFFFFFF) + LENGTH] for w in ws] for x, ws in zip(_utf8(texts), wanted)])

    # a repeated row has its regions once for each
    texts = docs.select("doc_id", "th", "text").where(maybe_in(docs, per_doc)).select(F.col("doc_id").alias("doc"), F.col("th").alias("h"), "text")
    met = texts.join(per_doc, texts["doc"].eqNullSafe(per_doc["doc_id"]) & (texts["h"] == per_doc["th"]))
    met = met.select(F.col("doc_id").cast("string").alias("doc_id"), "th", F.explode(F.arrays_zip("w", regions("text", "w").alias("x"))).alias("y"))
    i, j = F.shiftright("y.w.windows", 32), F.col("y.w.windows").bitwiseAND(F.lit(0xFFFFFFFF))
    met = table(met.select("doc_id", "th", "y.w.gram", "y.w.common", i.alias("i"), j.alias("j"), "y.x"), "regions")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, windows = [], 0
        for b in batches:
            held.append(b)
            windows += int((b["j"] - b["i"] + 1).sum())
            if windows >= _AT_ONCE:
                b = pd.concat(held, ignore_index=True)
                # the last prefix may go on in the next batch
                at = int(np.argmax(b["gram"].to_numpy() == b["gram"].iloc[-1]))
                if at:
                    yield from _compare(b.iloc[:at])
                held = [b.iloc[at:]]
                windows = int((held[0]["j"] - held[0]["i"] + 1).sum())
        if held and sum(map(len, held)):
            yield from _compare(pd.concat(held, ignore_index=True))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2000):
                part = b.iloc[k : k + 2000]
                owner, step, one, two = _windows(part)
                rows = part.iloc[owner]
                yield pd.DataFrame({"doc_id": rows["doc_id"], "th": rows["th"], "s": (rows["i"].to_numpy() + step).astype(np.int32), "one": one.view(np.int64), "two": two.view(np.int64)})

    few = met.where("not common").select("doc_id", "th", "gram", "i", "j", "x").repartition("gram").sortWithinPartitions("gram")
    spans = few.mapInPandas(compare, "doc_id string, th long, s int, e int")
    each = met.where("common").mapInPandas(spread, "doc_id string, th long, s int, one long, two long")
    twice = table(each.groupBy("one", "two").count().where("count > 1").select("one", "two"), "common-windows")
    more = each.join(twice, ["one", "two"], "left_semi").select("doc_id", "th", "s", (F.col("s") + LENGTH).cast("int").alias("e"))
    return spans.unionByName(more).select(F.col("doc_id").cast("long").alias("doc_id"), "th", "s", "e")


def _windows(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of rows (i, j, x): its row, its place in the run, and the hashes that tell it."""
    raw = np.frombuffer(b"".join(b["x"]), np.uint8)
    h = hashes(raw, 8)
    size = np.array([len(x) for x in b["x"]])
    n = (b["j"] - b["i"] + 1).to_numpy()
    owner = np.repeat(np.arange(len(b)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + step
    return owner, step, h[at], h[at + LENGTH - 256]


def _compare(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Ranges that windows equal to another's cover, of rows of whole prefix groups."""
    owner, step, one, two = _windows(b)
    again = repeated((one ^ (one >> np.uint64(30))) * _ODD[5] + two)
    start = again & ~np.r_[False, again[:-1] & (owner[1:] == owner[:-1])]
    end = again & ~np.r_[again[1:] & (owner[1:] == owner[:-1]), False]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    if len(s):
        rows = b.iloc[owner[s]]
        i = rows["i"].to_numpy()
        yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "th": rows["th"].to_numpy(), "s": (i + step[s]).astype(np.int32), "e": (i + step[e] + LENGTH).astype(np.int32)})


@dataclass
class Level:
    """A suffix array of different runs with its rank and the documents it is of."""

    rank: int
    stored: Stored
    docs: DataFrame

    @property
    def rows(self) -> int:
        return self.stored.rows

    @property
    def array(self) -> DataFrame:
        """The entries in the order of their suffixes."""
        return self.stored.kept().select(*ENTRY).sort(*ENTRY)


class IndexFamily:
    """Levels of suffix arrays: a batch has rank 0, and two levels of a rank make one of the next."""

    def __init__(self):
        self.levels: list[Level] = []
        self.merges = 0

    def add(self, docs: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Indexes a batch (doc_id, th, text) and scans it with itself and with what is indexed.

        Returns the ranges (doc_id, th, s, e) of equal runs, on both sides, and the runs that compared()
        is to take further, with the documents of the batch and all levels. entries: the batch's, if they are written already.
        """
        entries = table(suffixes(docs), "suffixes") if entries is None else entries
        rows = entries.count()
        batch = Stored(batch_scan(entries, rows), rows // RANGE + 1, "batch-scan")
        flagged = batch.table.where("again or stands").select(*ENTRY, "again", "stands")
        for level in self.levels:
            if level.rows and batch.rows:
                flagged = flagged.unionByName(merge_scan(level.stored, batch.kept()))
        flagged = table(flagged, "flagged")
        whole = flagged.where("again").select("doc_id", "th", F.shiftright("windows", 32).cast("int").alias("s"), (F.col("windows").bitwiseAND(F.lit(0xFFFFFFFF)) + LENGTH).cast("int").alias("e"))
        runs = flagged.where("stands").select("gram", "doc_id", "th", "windows")
        new, rank = batch, 0
        while self.levels and self.levels[-1].rank == rank:
            older = self.levels.pop()
            both = merge(older.stored, new) if older.rows and new.rows else new if new.rows else older.stored
            for x in (older.stored, new):
                if x is not both:
                    x.drop()
            new, docs, rank, self.merges = both, docs.unionByName(older.docs), rank + 1, self.merges + 1
        self.levels.append(Level(rank, new, docs))
        return whole, runs

    def repeats(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch and returns the ranges (doc_id, th, s, e) of repeats that it has with itself
        or with what is indexed, on both sides."""
        texts = docs
        for level in self.levels:
            texts = texts.unionByName(level.docs)
        whole, runs = self.add(docs)
        return whole.unionByName(compared(runs, texts))

    def drop(self) -> None:
        for level in self.levels:
            level.stored.drop()
        self.levels.clear()


def merged(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Disjoint ranges that touch nowhere, in order."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, n)) for s, e in out]


def ranges(docs: DataFrame, batches: int = 4) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, text, th), and the (s, e) byte ranges to remove of those that have any.

    The batches are dealt by text hash. Runs that differ are compared once, after the last batch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", text_hash())
    family, whole, runs = IndexFamily(), [], []
    # texts are read once for the entries of all batches
    path = scratch(docs.sparkSession, "suffixes")
    suffixes(rows).withColumn("batch", F.pmod("th", F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    entries = docs.sparkSession.read.schema(", ".join(f"{c} long" for c in ENTRY) + ", batch int").parquet(path)
    for k in range(batches):
        equal, differ = family.add(rows.where(F.pmod("th", F.lit(batches)) == k), entries.where(F.col("batch") == k).drop("batch"))
        whole.append(equal)
        runs.append(differ)
    family.drop()
    found = compared(reduce(DataFrame.unionByName, runs), rows)
    found = reduce(DataFrame.unionByName, whole, found)
    return rows, table(found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "ranges")


def without_repeats(docs: DataFrame, batches: int = 4) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes.

    A byte goes if a LENGTH-byte string that covers it also starts at another place, of any row. Null
    texts count as empty; nothing of texts under LENGTH bytes goes; repeated rows repeat each other. An
    empty table gives an empty result; columns other than doc_id and text are ignored.
    """

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for x, own in zip(_utf8(texts), ranges):
            spans = merged([(r["s"], r["e"]) for r in own], len(x)) if own is not None else []
            kept = b"".join(x[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(x)]))
            out.append((len(x), len(x) - len(kept), len(spans), kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    rows, found = ranges(docs, batches)
    found = found.select(F.col("doc_id").alias("doc"), F.col("th").alias("h"), "ranges")
    may = rows.withColumn("may", maybe_in(rows, found.select(F.col("doc").alias("doc_id"), F.col("h").alias("th"))))
    some = may.where("may").join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("h")), "left")
    some = some.select("doc_id", cut("text", "ranges").alias("c")).select("doc_id", "c.*")
    none = may.where("not may").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    return some.unionByName(none).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")


def sql(name: str = "documents", length: int = LENGTH) -> str:
    """DuckDB SQL for the columns of without_repeats but kept: every window of every text by its hash, told
    apart by 64 bits; windows that recur are joined to islands, and what is left of a text is hashed."""
    step = 400
    return f"""
        with d as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) x from {name}),
        l as (select *, length(x) // 2 n from d),
        seg as (select rid, s, substr(x, 2 * s + 1, 2 * ({step} + {length} - 1)) y from (select rid, x, unnest(range(0, n - {length} + 1, {step})) s from l where n >= {length})),
        w as (select rid, s + i p, hash(substr(y, 2 * i + 1, 2 * {length})) h from (select rid, s, y, unnest(range(0, least({step}, length(y) // 2 - {length} + 1))) i from seg)),
        hit as (select rid, p from w where h in (select h from w group by h having count(*) > 1)),
        g as (select rid, p, case when p <= lag(p) over (partition by rid order by p) + {length} then 0 else 1 end fresh from hit),
        k as (select rid, p, sum(fresh) over (partition by rid order by p) k from g),
        s as (select rid, min(p) a, max(p) + {length} b from k group by rid, k),
        t as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) z from s),
        u as (select rid, sum(b - a) n_removed, count(*) n_spans, max(b) z, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' order by a) kept from t join l using (rid) group by rid)
        select doc_id, n n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * u.z + 1), x))) kept_sha256
        from l left join u using (rid)"""
