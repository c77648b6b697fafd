"""SimHash near-duplicates: fingerprints, BK-trees over shards of fingerprints, connected components.

A shard holds the distinct fingerprints that agree on a key of some bits. The task that owns a shard
builds its BK-tree (children keyed by their Hamming distance to the parent) and every fingerprint of
the shard follows only edges within the radius. With `blocks`, the keys are all choices of
`blocks - radius` whole blocks: at most `radius` differing bits leave that many blocks alike, so no
link is lost.

The trees go to one task each, not to all: a tree grows with the data and has no size bound. A shard of
more than SHARD fingerprints is cut into blocks, and each pair of blocks is a shard of its own, so that
what a task holds is bounded however alike the documents are.

`near_dedup` goes the same way over fingerprints of shingle sets, with a radius that holds every pair of the wanted
share of common shingles; what the trees link is then decided exactly on the sets. At that radius no
choice of fingerprint bits makes shards that are small and lose nothing, so MinHash bands key them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.components import components
from quorumlake.llm.shared import fresh, small_batches, table, text_hash

SEED = 42
#: Pairs of fingerprint and tree node that a search holds at once.
FRONTIER = 250_000
#: Fingerprints of a shard, and shingles of a candidate group, beyond which it is cut into blocks.
SHARD, GROUP = 20_000, 4_000_000
#: Fingerprints of whole shards that a task takes at once.
_AT_ONCE = 100_000


@dataclass(frozen=True)
class Plan:
    """words of a shingle, 64-bit lanes of a fingerprint, radius, and how shards are keyed."""

    words: int = 5
    lanes: int = 1
    radius: int = 4
    blocks: int = 6


@dataclass(frozen=True)
class Alike:
    """words of a shingle, least Jaccard similarity (num / den) of linked documents, MinHash bands that key the
    shards, and lanes and radius of the fingerprints of shingle sets.

    A band holds `rows` minima. A pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^50, which
    misses 3 in 10 million, and any closer pair fewer. Its fingerprints differ in 15 % of the bits, and at most
    in 18.75 % (sets of four and five shingles), so that a radius of 54 in 128 misses 3 in 10 billion.
    """

    words: int = 5
    num: int = 4
    den: int = 5
    bands: int = 50
    rows: int = 6
    lanes: int = 2
    radius: int = 54


SIMILAR = Alike()


def _mix(h: np.ndarray) -> np.ndarray:
    """A second hash of each hash, by xor-shifts and multiplications."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the A-Z-lower-cased text, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(w) - words + 1)
    last = min(words, len(w)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n], ends[last : last + n])), np.uint64, n)


def majority(h: np.ndarray, lanes: int) -> list[int]:
    """lanes of 64 bits; a bit is 1 if over half of the hashes have it. No hash: zeros."""
    out = []
    for _ in range(lanes):
        if not len(h):
            out.append(0)
            continue
        set_bits = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            part = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits += part.sum(0, dtype=np.uint16)
        out.append(int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0]))
        h = _mix(h)
    return out


def fingerprint(text: str | None, words: int = 4, lanes: int = 1) -> list[int]:
    """lanes of 64 bits; a bit is 1 if over half of the shingles' hashes have it. No word: zeros."""
    return majority(shingle_hashes(text, words), lanes)


def _lanes(plan: Plan | Alike) -> list[str]:
    return [f"f{k}" for k in range(plan.lanes)]


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, th, f0, ...) of each row; th is a hash of the text, which tells rows of one id apart."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprint(t, plan.words, plan.lanes), np.uint64).astype(np.int64) for t in texts])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", text_hash().alias("th"), of("text").alias("f"))
    return rows.select("doc_id", "th", *[F.col("f")[k].alias(c) for k, c in enumerate(_lanes(plan))])


def shard_keys(f: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, keys): the shards of each fingerprint (rows, lanes)."""
    edges = np.linspace(0, 64, plan.blocks + 1).round().astype(int)
    own = [(f[:, 0] >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:])]
    wide = [int(b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for k, chosen in enumerate(combinations(range(plan.blocks), plan.blocks - plan.radius)):
        key = np.zeros(len(f), np.uint64)
        for c in chosen:
            key = (key << np.uint64(wide[c])) | own[c]
        out.append(key.astype(np.int64) + (k << 40))
    return np.stack(out, 1)


def _apart(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[a] ^ f[b]).sum(1, dtype=np.int64)


def bk_forest(f: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree per group (sorted ids), built level by level over all groups at once.

    Returns each item's root, and its children: where they start, their items and edge distances.
    """
    n = len(group)
    first = np.r_[True, group[1:] != group[:-1]]
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    item, at = np.flatnonzero(~first), root[~first]
    while len(item):
        d = _apart(f, item, at)
        order = np.lexsort((item, d, at))
        item, at, d = item[order], at[order], d[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])]
        head = item[new]
        parent[head], edge[head] = at[new], d[new]
        at = head[np.cumsum(new) - 1][~new]
        item = item[~new]
    child = np.flatnonzero(parent >= 0)
    child = child[np.lexsort((edge[child], parent[child]))]
    start = np.searchsorted(parent[child], np.arange(n + 1))
    return root, start, child, edge[child]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def linked(f: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Each item's least item that links of at most radius bits within its group lead to.

    A subtree on an edge within the radius is linked to its node whole, so what links with the node
    doesn't enter it: a shard of near copies costs one comparison each.
    """
    order = np.lexsort((*f.T, group))
    new = np.ones(len(group), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(f[order], axis=0) != 0).any(1)
    if not new.all():
        # equal ones are one, the least of them
        least, own = order[new], np.sort(order[new])
        stands = np.empty(len(group), int)
        stands[order] = least[np.cumsum(new) - 1]
        return own[linked(f[own], group[own], radius)[np.searchsorted(own, stands)]]
    label = np.arange(len(group))
    root, start, child, edge = bk_forest(f, group)
    sizes = np.bincount(root, minlength=len(group))[root]
    done = 0
    while done < len(group):
        upto = done + max(1, int(np.searchsorted(np.cumsum(sizes[done:]), FRONTIER)))
        q, node = np.arange(done, min(upto, len(group))), root[done:upto]
        while len(q):
            d = _apart(f, q, node)
            near = (d <= radius) & (q != node)
            _union(label, q[near], node[near])
            n = start[node + 1] - start[node]
            step = np.repeat(start[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            follow = (np.abs(edge[step] - np.repeat(d, n)) <= radius) & ((edge[step] > radius) | np.repeat(d > radius, n))
            q, node = np.repeat(q, n)[follow], child[step[follow]]
        done = upto
    return label


def _block_pairs(rows: DataFrame, key: str, node: str, blocks: str) -> DataFrame:
    """rows with one and two, a pair of blocks of its key: a row comes once for each block its own meets.

    blocks is the column of how many blocks the key has; 1 leaves a row as it is.
    """
    own = F.pmod(F.xxhash64(node, F.lit(1)), F.col(blocks))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    rows = rows.withColumn("own_block", own.cast("long")).withColumn("met_block", met)
    return rows.withColumn("one", F.least("own_block", "met_block")).withColumn("two", F.greatest("own_block", "met_block")).drop("own_block", "met_block", blocks)


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) links that span each shard's linked groups of nodes (node, f0, ...); no pair lists."""
    lanes = _lanes(plan)
    schema = ", ".join(f"{c} long" for c in ("shard", "node", *lanes))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = shard_keys(b[lanes].to_numpy(np.int64).view(np.uint64), plan)
                again = np.repeat(np.arange(len(b)), keys.shape[1])
                yield b.iloc[again].assign(shard=keys.ravel())[["shard", "node", *lanes]]

    return shard_links(nodes.select("node", *lanes).mapInPandas(keyed, schema), plan)


def shard_links(dealt: DataFrame, plan: Plan | Alike) -> DataFrame:
    """links() of fingerprints that are dealt to shards already (shard, node, f0, ...)."""
    lanes = _lanes(plan)

    def found(b: pd.DataFrame) -> pd.DataFrame:
        key = b[["shard", "one", "two"]].to_numpy(np.int64)
        new = np.r_[True, (key[1:] != key[:-1]).any(1)]
        alone = new & np.r_[new[1:], True]
        node, f, shard = b["node"].to_numpy()[~alone], b[lanes].to_numpy(np.int64).view(np.uint64)[~alone], np.cumsum(new)[~alone]
        label = linked(f, shard, plan.radius)
        tied = label != np.arange(len(label))
        return pd.DataFrame({"a": node[tied], "b": node[label[tied]]}).drop_duplicates()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= _AT_ONCE:
                b = pd.concat(held, ignore_index=True)
                # the last shard may go on in the next batch
                same = (b[["shard", "one", "two"]] == b[["shard", "one", "two"]].iloc[-1]).all(axis=1).to_numpy()
                at = int(np.argmax(same))
                if at:
                    yield found(b.iloc[:at])
                held = [b.iloc[at:]]
        if sum(map(len, held)):
            yield found(pd.concat(held, ignore_index=True))

    key = F.col("shard")
    large = table(dealt.groupBy("shard").count().where(F.col("count") > SHARD).select("shard", F.ceil(F.col("count") / SHARD).alias("blocks")), "large-shards")
    if large.isEmpty():
        dealt = dealt.withColumn("one", F.lit(0).cast("long")).withColumn("two", F.lit(0).cast("long"))
    else:
        cut = dealt.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        dealt = _block_pairs(cut, "shard", "node", "blocks")
    dealt = dealt.repartition(key, "one", "two").sortWithinPartitions("shard", "one", "two", "node")
    return dealt.mapInPandas(search, "a long, b long")


def groups(docs: DataFrame, plan: Plan) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, th, f0, ..., component_id (smallest doc_id reachable).

    A null or wordless text has fingerprint zero and links as any other; equal rows share a row's fate;
    a null doc_id links but is never a component_id unless all of its group are null. Other columns of
    docs are ignored. An empty table gives an empty result.
    """
    lanes = _lanes(plan)
    fps = table(fingerprints(docs, plan), "fingerprints")
    # one lane is its own node id; several are told apart by a 64-bit hash
    node = F.col("f0") if plan.lanes == 1 else F.xxhash64(*lanes)
    nodes = fps.groupBy(*lanes).agg(F.min("doc_id").alias("least")).withColumn("node", node)
    roots = components(links(nodes, plan))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = placed.join(ids, "root").select(*lanes, "component_id")
    return fps.join(by_node, lanes)


def _steps(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the hash functions that the minima are taken of."""
    pick = np.random.default_rng(SEED)
    mul, add = pick.integers(0, 2**64, (2, count), np.uint64)
    return mul | np.uint64(1), add


def bands(shingles: np.ndarray, plan: Alike) -> np.ndarray:
    """A hash per MinHash band of a set of shingle hashes; equal sets have equal ones, the empty set zeros."""
    if not len(shingles):
        return np.zeros(plan.bands, np.int64)
    mul, add = _steps(plan.bands * plan.rows)
    least = np.full(len(mul), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * mul + add
        # the product's low bits are weak, so its high half is folded in before the order is taken
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(0))
    out = np.arange(plan.bands, dtype=np.uint64)
    for column in least.reshape(plan.bands, plan.rows).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def alike(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Each set's least number that pairs with a Jaccard similarity of num / den or more lead to. Exact.

    A set of n shingles shares at least ceil(n * num / den) with any partner, so one of its
    n - ceil(...) + 1 rarest is among the partner's rarest. Sets are taken breadth first: what is
    reached needs no further comparison but its own with the rest.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    label = np.arange(n)
    empty = np.flatnonzero(size == 0)
    label[empty] = empty[:1].repeat(len(empty))
    if not size.sum():
        return label
    _, word, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((rank[word], owner))
    word = rank[word][order]
    start = np.r_[0, np.cumsum(size)]
    head = size - -(-size * num // den) + 1
    rare = np.arange(len(word)) - start[owner] < head[owner]
    post_word, post = word[rare], owner[rare]
    by = np.argsort(post_word, kind="stable")
    post = post[by]
    at = np.searchsorted(post_word[by], np.arange(len(often) + 1))
    mine, waits = np.zeros(len(often), bool), size > 0
    for first in range(n):
        if not waits[first]:
            continue
        waits[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            own = word[start[i] : start[i] + size[i]]
            near = np.concatenate([post[at[w] : at[w + 1]] for w in own[: head[i]].tolist()])
            near = np.unique(near[waits[near]])
            near = near[(size[near] * den >= size[i] * num) & (size[i] * den >= size[near] * num)]
            if not len(near):
                continue
            mine[own] = True
            for part in np.array_split(near, size[near].sum() // 4_000_000 + 1):
                ends = np.cumsum(size[part])
                flat = np.arange(ends[-1]) + np.repeat(start[part] - ends + size[part], size[part])
                both = np.add.reduceat(mine[word[flat]].astype(np.int64), ends - size[part])
                hit = part[both * den >= (size[i] + size[part] - both) * num]
                waits[hit], label[hit] = False, first
                queue += hit.tolist()
            mine[own] = False
    return label


def _large(asked: DataFrame) -> DataFrame:
    """(root, blocks) of the groups of asked (root, size) with more than GROUP shingles."""
    size = asked.groupBy("root").agg(F.sum("size").alias("size")).where(F.col("size") > GROUP)
    return table(size.select("root", F.ceil(F.col("size") / GROUP).alias("blocks")), "large-groups")


def nearby(asked: DataFrame, large: DataFrame, texts: DataFrame, own_set, plan: Alike, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """asked (root, node, th, size) less rows of large groups that need no more comparison, and their links (a, b).

    Each round compares every row of a group with the least node, the pivot. One minus the similarity is
    a metric: with t the distance that links and d the least distance over t to the pivot, a row within
    d - t of the pivot links with no row that the pivot doesn't. Such rows get their link to it and go.
    """
    far = 1 - plan.num / plan.den

    @F.pandas_udf("double")
    def apart(one: pd.Series, two: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for a, b in zip(one, two):
            if b not in known:
                known = {b: own_set(b)}
            x, y = own_set(a), known[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            out.append(0.0 if not union else (1 - both / union) if both * plan.den < union * plan.num else min(far, 1 - both / union))
        return pd.Series(out)

    own = ["root", "node", "th", "size"]
    rest = table(asked.join(large, "root", "left_semi").join(texts, "th").select(*own, "text"), "large-groups")
    found = []
    for _ in range(rounds):
        pivot = rest.groupBy("root").agg(F.min(F.struct("node", "text")).alias("p"))
        # written, so that it is known to be small where it is
        pivot = table(pivot.select("root", F.col("p.node").alias("pivot"), F.col("p.text").alias("pivot_text")), "pivots")
        met = table(rest.join(pivot, "root").select("root", "node", "pivot", apart("text", "pivot_text").alias("d")), "distances")
        near = F.col("d") <= far
        least = met.groupBy("root").agg(F.min(F.when(~near, F.col("d"))).alias("least"))
        found.append(met.where(near & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        done = near & (F.col("least").isNull() | (F.col("d") < F.col("least") - far - 1e-9))
        stay = met.join(least, "root").where(~done).select("node")
        rest = table(rest.join(stay, "node", "left_semi"), "large-groups")
        if rest.isEmpty():
            break
    return asked.join(large, "root", "left_anti").unionByName(rest.select(*own)), reduce(DataFrame.unionByName, found)


def similar_groups(docs: DataFrame, plan: Alike = SIMILAR) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, th, component_id (smallest doc_id reachable).

    Links are pairs of texts whose sets of shingles have at least the plan's similarity; shingles are
    told apart by 64-bit hashes. BK-trees over the fingerprints of each band's shards join candidates, whose
    texts then meet in one task per joined group and are compared exactly; a group of more than GROUP shingles is first thinned by nearby(),
    and then cut into blocks, each pair of which has its task. Wordless texts are alike; null ids are as
    in groups.
    """
    small_batches(docs.sparkSession)
    own_set = lambda t: np.unique(shingle_hashes(t, plan.words))
    lanes = _lanes(plan)

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        sets = [own_set(t) for t in texts]
        prints = [np.array(majority(x, plan.lanes), np.uint64).view(np.int64) for x in sets]
        return pd.Series([np.r_[np.int64(xxhash.xxh64_intdigest(x.tobytes(), SEED) - 2**63), len(x), f, bands(x, plan)] for x, f in zip(sets, prints)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = rows.select("doc_id", text_hash().alias("th"), keys("text").alias("k"))
    own = [F.col("k")[i].alias(c) for i, c in enumerate(["node", "size", *lanes])]
    marks = table(marks.select("doc_id", "th", *own, F.slice("k", len(own) + 1, plan.bands).alias("k")), "bands")
    # rows of equal sets are one node, for which the text of least hash stands
    nodes = marks.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("size", *lanes, "k")])
    nodes = table(nodes, "sets")
    shared = nodes.select("node", F.explode("k").alias("shard"))
    met = shared.groupBy("shard").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low <> top")
    dealt = shared.join(met.select("shard"), "shard", "left_semi").join(nodes.select("node", *lanes), "node")
    joined = components(shard_links(table(dealt.select("shard", "node", *lanes), "shards"), plan))
    asked = table(nodes.join(joined, "node").select("root", "node", "th", "size"), "candidates")
    large = _large(asked)
    texts = rows.select(text_hash().alias("th"), "text").join(asked.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        label = alike([own_set(t) for t in group["text"]], plan.num, plan.den)
        return pd.DataFrame({"node": group["node"], "head": group["node"].to_numpy()[label]})

    if large.isEmpty():
        heads = table(asked.join(texts, "th").select("root", "node", "text").groupBy("root").applyInPandas(verify, "node long, head long"), "verified")
    else:
        asked, near = nearby(asked, large, texts, own_set, plan)
        cut = asked.join(_large(asked), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        pairs = _block_pairs(cut, "root", "node", "blocks").join(texts, "th").select("root", "one", "two", "node", "text")
        found = pairs.groupBy("root", "one", "two").applyInPandas(verify, "node long, head long")
        found = found.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        heads = components(found.unionByName(near)).withColumnRenamed("root", "head")
    placed = nodes.select("node", "least").join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    ids = placed.groupBy("head").agg(F.min("least").alias("component_id"))
    return marks.select("doc_id", "th", "node").join(placed.join(ids, "head").select("node", "component_id"), "node").drop("node")


def near_dedup(docs: DataFrame, plan: Alike = SIMILAR) -> DataFrame:
    """The rows of docs (all columns) less all but one of each group: that of the smallest doc_id.

    Of rows with that id, the one with the least text hash stays, once.
    """
    stays = similar_groups(docs, plan).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("s"))
    key, h = fresh(docs.columns, "stay_id"), fresh(docs.columns, "stay_th")
    stays = stays.select(F.col("s.doc_id").alias(key), F.col("s.th").alias(h)).distinct()
    rows = docs.withColumn(h, text_hash())
    kept = rows.join(stays, rows["doc_id"].eqNullSafe(stays[key]) & (rows[h] == stays[h]), "left_semi")
    return kept.dropDuplicates(["doc_id", h]).drop(h)
