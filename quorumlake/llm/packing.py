"""Best-fit packing into sequences of a fixed length, mended by swap-based local search.

Texts become token ids; only texts longer than a sequence are cut, into whole sequences and a shorter
first piece. Whole pieces fill a sequence each. The others are dealt at random to shards of about
SHARD pieces; each shard packs its own by best fit and then searches: it moves a piece, or exchanges
one for one or two for one, between underfull sequences whenever that raises the sum of squared fills,
until a sequence empties. The sequences a shard leaves underfull are dealt again and searched once
more, in fewer shards, so that the loss does not grow with the number of shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import small_batches, table

LIMIT, END = 2048, 0
#: Pieces that a shard packs, about.
SHARD = 20_000
_ODD = regex.compile(r"[^\x00-ɏ‐-‧]")


class Encoder:
    """Token ids of the byte-level vocabulary file, as little-endian unsigned 32-bit bytes.

    The `tokenizers` library defines them. tiktoken gives the same ids from the same vocabulary six
    times as fast, and encodes the texts of Latin letters and common punctuation without the special
    token's name; all others go to `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None, special: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.own, self.fast, self.special = Tokenizer.from_file(path), None, special
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        ids = None
        if self.fast and self.special not in text and not _ODD.search(text):
            try:
                ids = self.fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001  its panics are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if ids is None:
            ids = self.own.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END], "<u4")


def default_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_encoders: dict = {}


def cut(ids: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces: whole ones, after a first one that may be shorter."""
    head = len(ids) % limit or limit
    edges = [0, *range(head, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
    return [(k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, encoder=default_encoder, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row; encoder makes an Encoder on a worker."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def of(texts: pd.Series) -> pd.Series:
        if encoder not in _encoders:
            _encoders[encoder] = encoder()
        return pd.Series([[dict(zip(("piece", "start", "length", "ids_crc32"), p)) for p in cut(_encoders[encoder](t), limit)] for t in texts])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.explode(of("text")).alias("p")).select("doc_id", "p.*")


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that it fits."""
    room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    bins: list[list[int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            left, b = limit, len(bins)
            bins.append([])
        bins[b].append(k)
        left -= n
        if left:
            if left not in room:
                rooms.insert(bisect_left(rooms, left), left)
            room[left].append(b)
    return bins


def _makes_room(own: list[int], gap: int, n: int) -> list[int] | None:
    """Of sizes own, in order, the least one or two that n may be exchanged for, none if n fits; else None."""
    if n <= gap:
        return []
    need, best, out = n - gap, n, None
    at = bisect_left(own, need)
    if at < len(own) and own[at] < best:
        best, out = own[at], [own[at]]
    for a, x in enumerate(own):
        if 2 * x >= best:
            break
        at = bisect_left(own, need - x, lo=a + 1)
        if at < len(own) and x + own[at] < best:
            best, out = x + own[at], [x, own[at]]
    return out


def local_search(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Moves and swaps pieces between underfull bins while the sum of squared fills rises.

    Each round takes the least full bin as giver. A piece of it moves to, or is exchanged for one or
    two smaller pieces of, the fullest underfull bin that can take it, at least as full as the giver; what
    comes back is less than what went, so the fuller bin gains and the giver drains until it is empty. The
    search ends when no piece of any giver finds a partner, or when there are as few bins as the total of
    lengths asks for.

    Sizes that found no partner are remembered with the fill down to which bins were asked, and asked
    again only of emptier bins and of bins that changed since.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    own = [sorted(size[i] for i in b) for b in bins]
    left = sum(1 for b in bins if b)
    enough = -(-sum(size) // limit)
    heap = [(n, k) for k, n in enumerate(fill) if 0 < n < limit]
    heapify(heap)
    by_fill = sorted((k for _, k in heap), key=lambda k: -fill[k])
    barren: dict[int, int] = {}
    aside: set[int] = set()

    def partner(n: int, giver: int, below: int) -> tuple[int, list[int]] | None:
        """The fullest bin under `below` that takes n of giver."""
        for k in by_fill[bisect_left(by_fill, 1 - below, key=lambda k: -fill[k]) :]:
            if fill[k] < fill[giver]:
                return None
            if k != giver and (back := _makes_room(own[k], limit - fill[k], n)) is not None:
                return k, back
        return None

    def refill(k: int, n: int) -> None:
        if 0 < fill[k] < limit:
            at = bisect_left(by_fill, -fill[k], key=lambda j: -fill[j])
            del by_fill[by_fill.index(k, at)]
        fill[k] = n
        if 0 < n < limit:
            by_fill.insert(bisect_left(by_fill, -n, key=lambda j: -fill[j]), k)

    while heap and left > enough:
        n, giver = heappop(heap)
        if n != fill[giver] or giver in aside:
            continue
        found = None
        for x in sorted(set(own[giver]), reverse=True):
            below = barren.get(x, limit)
            found = partner(x, giver, below) if n < below else None
            if found:
                break
            barren[x] = min(n, below)
        if not found:
            aside.add(giver)
            continue
        k, back = found
        for source, target, moved in ((giver, k, [x]), (k, giver, back)):
            for m in moved:
                i = next(i for i in bins[source] if size[i] == m)
                bins[source].remove(i)
                bins[target].append(i)
                own[source].remove(m)
                insort(own[target], m)
        refill(k, fill[k] + x - sum(back))
        refill(giver, fill[giver] - x + sum(back))
        left -= not bins[giver]
        revived = {m for m, low in barren.items() for t in (k, giver) if low <= fill[t] < limit and _makes_room(own[t], limit - fill[t], m) is not None}
        if revived:
            for m in revived:
                del barren[m]
            for t in [t for t in aside if not revived.isdisjoint(own[t])]:
                aside.discard(t)
                heappush(heap, (fill[t], t))
        for t in (k, giver):
            if 0 < fill[t] < limit:
                aside.discard(t)
                heappush(heap, (fill[t], t))
    return [b for b in bins if b]


def pack(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The bin number of each item, numbered from 0."""
    out = np.zeros(len(lengths), np.int64)
    for k, b in enumerate(local_search(best_fit(lengths, limit), lengths, limit)):
        out[b] = k
    return out


def place(cut_pieces: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """cut_pieces (length, and any columns) with sequence_id and offset.

    Shards are as many as the pieces ask for; a shard's size is what one task holds. Which shard a
    piece goes to is drawn from its row's hash with its number, so copies spread evenly.
    """
    own = cut_pieces.columns
    full = cut_pieces.where(F.col("length") >= limit)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    small = cut_pieces.where(F.col("length") < limit).withColumn("item", F.monotonically_increasing_id())
    small = table(small, "short-pieces")
    schema = "item long, sequence_id long, offset long"

    def in_shards(rows: DataFrame, tag: int) -> DataFrame:
        """rows (item, length): packs each of as many shards as the rows need."""
        n = max(1, -(-rows.count() // shard))

        def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
            got = got.sort_values(["length", "item"], ascending=[False, True], kind="stable")
            bins = pack(got["length"].to_numpy(np.int64), limit)
            got = got.assign(sequence_id=bins + (int(key[0]) << 28) + (tag << 60))
            got = got.sort_values(["sequence_id", "item"], kind="stable")
            got["offset"] = got.groupby("sequence_id")["length"].cumsum() - got["length"]
            return got[["item", "sequence_id", "offset"]]

        dealt = rows.select("item", "length", F.pmod(F.xxhash64("item", F.lit(tag)), F.lit(n)).alias("shard"))
        return dealt.groupBy("shard").applyInPandas(run, schema)

    first = table(in_shards(small, 0).join(small.select("item", "length"), "item"), "packed")
    fills = first.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    # what shards could not fill meets once more
    under = fills.where(F.col("fill") < limit).select("sequence_id")
    again = table(first.join(under, "sequence_id", "left_semi").select("item", "length"), "underfull")
    second = in_shards(again, 1)
    done = first.join(under, "sequence_id", "left_anti").select("item", "sequence_id", "offset")
    placed = small.join(done.unionByName(second), "item").select(*own, "sequence_id", "offset")
    return placed.unionByName(full.select(*own, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, encoder=default_encoder, limit: int = LIMIT) -> DataFrame:
    """Per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed each. An empty
    table gives an empty result; columns other than doc_id and text are ignored.
    """
    made = table(pieces(docs, encoder, limit), "pieces")
    return place(made, limit)
