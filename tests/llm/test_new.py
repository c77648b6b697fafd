"""Operators 11 to 13 against brute force, SQL and hard cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import assert_same, connect
from quorumlake.llm import periodic, queries, simhash, spelling, vafile
from test_llm import hard

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_periodic_runs", "op13_exact_top_k"])
def test_query_matches_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


# ---- 11: spelling variants


def near(a, b):
    """Distance one, by leaving out the common beginning and end."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def slow_variants(rows):
    n = Counter()
    for k, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
            h = crc32(f"{k}:{w}".encode()) if k is not None else 1
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(close)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


@given(st.lists(st.text("abcé", min_size=0, max_size=7), unique=True, max_size=40))
@settings(max_examples=200, deadline=None)
def test_trie_pairs_by_brute_force(words):
    got = list(spelling.trie_pairs(words))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("size", [50_000, 20, 3])
def test_pairs_over_parts(spark, size):
    """Parts are dealt again down to a few words; words share long beginnings and ends."""
    rnd = random.Random(size)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(6, 10))) for _ in range(250)}
    words |= {f"{'x' * 9}{c}{d}" for c in "abcd" for d in "abcdef"} | {f"{c}{'y' * 10}" for c in "abcdef"} | {"ététété", "ététeté", "aaaaaa", "aaaaaaa"}
    got = spelling.near_pairs(spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long"), size).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, len(a), b, len(b)) for a in words for b in words if near(a, b)}


def test_variants_by_brute_force(spark):
    rnd = random.Random(3)
    stems = ["colour", "côlours", "colours", "COLOUR", "collour", "colr", "harbour", "harbor", "harbors", "xarbour"]
    more = [(k, " ".join(rnd.choices(stems, [90, 15, 80, 30, 3, 9, 500, 60, 8, 2], k=60))) for k in range(100, 160)]
    docs = hard(spark, more)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = slow_variants(rows)
    assert len(got) == len(want) and set(got) == want and any(f and r != f for _, f, r, *_ in want)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    """Eight steps to the root."""
    rows = [(f"w{i}", f"w{i + 1}") for i in range(8)] + [("x", "y")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w8" for i in range(8)}, "x": "y"}


# ---- 12: runs


def slow_runs(w):
    least = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                least.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in least.items())


def pieces(rnd):
    w = []
    for _ in range(rnd.randrange(6)):
        p = [rnd.randrange(5) for _ in range(rnd.randrange(1, 8))]
        w += (p * 9)[: rnd.randrange(1, 8 * len(p))]
    return w


@given(st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_runs_by_brute_force(rnd):
    texts = [pieces(rnd) for _ in range(4)] + [[rnd.randrange(2) for _ in range(rnd.randrange(40))]]
    for w in texts:
        assert periodic.runs(w) == slow_runs(w)
    sizes = np.array([len(w) for w in texts])
    got, start = [[] for _ in texts], np.r_[0, np.cumsum(sizes)]
    for a, b in periodic.stretches(np.array(sum(texts, []), np.int64), sizes):
        k = int(np.searchsorted(start, a, "right")) - 1
        assert b <= start[k + 1]
        got[k] += [(a - start[k] + s, n, q) for s, n, q in periodic.runs(sum(texts, [])[a:b])]
    assert [sorted(x) for x in got] == [slow_runs(w) for w in texts]


def test_blocks_of_ends(monkeypatch):
    monkeypatch.setattr(periodic, "_BLOCK", 8)
    rnd = random.Random(5)
    for w in ([1] * 300, [i % 7 for i in range(200)], [rnd.randrange(2) for _ in range(300)]):
        assert periodic.runs(w) == slow_runs(w)


def test_periodic_documents(spark):
    rnd = random.Random(7)
    more = [(k, " ".join(f"w{x}" for x in pieces(rnd))) for k in range(200, 320)] + [(k, "é\xa0a b\x1cc\x0bd " * 30) for k in range(400, 420)]
    docs = hard(spark, more)
    want = []
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        h = crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 2000:
            # the long text repeats itself from end to end, and as often if it is looped
            got_runs = periodic.runs([{x: i for i, x in enumerate(dict.fromkeys(w))}[x] for x in w])
        else:
            got_runs = slow_runs(w)
        best = min(got_runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {i for s, n, q in got_runs for i in range(s + q, s + n)}
        head = (None,) * 4 if best is None else (*best, math.floor(1000 * best[1] / best[2]))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(got_runs, key=lambda x: (x[0], x[2])))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r["doc_id"], len(got_runs), *head, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest()))
    found = periodic.periodic_runs(docs)
    assert sorted([tuple(r) for r in found.drop("runs", "collapsed").collect()], key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 60
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    """Over a million words, half of them one word: the automaton gets only what recurs."""
    rnd = random.Random(1)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(600_000)) + " x" * 400_000 + " y" + " a b c" * 5
    r = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (2, 600_000, 400_000, 1)


# ---- 13: exact search


def slow_top(rows, k=5, every=50):
    v = []
    for i, x in rows:
        if i is None or not x or any(y is None or not math.isfinite(y) for y in x):
            continue
        v.append((i, tuple(math.floor(256 * float(np.float32(y))) for y in x)))
    v = sorted(set(v))
    out = set()
    for a in v:
        if a[0] % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0]) for b in v if b != a)[:k]
            out |= {(a[0], r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def vectors(seed, n=400, d=6):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.normal(0, 3, d).astype(np.float32).tolist()) for i in range(n)]
    same = rows[50][1]
    rows += [(i, same) for i in range(1000, 1400)]  # copies of one vector, queries among them
    rows += [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan")] * d), (100, [float("inf")] * d), (None, same), (5, [0.5]), (7000, [1.0] * (d + 2)), (50, same)]
    rows += [(i, [0.0] * d) for i in range(2000, 2060)]
    return rows


@pytest.mark.parametrize("block, first", [(1 << 20, 4), (60, 1)])
def test_top_by_brute_force(spark, block, first, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "FIRST", first)
    rows = vectors(block)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, class int, v int")
    got = [tuple(r) for r in vafile.top(df).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_top(rows)
    assert vafile.top(df.limit(0)).count() == 0
    assert vafile.top(df.where("vec_id = 50")).count() == 0


def test_few_vectors_are_read(spark):
    """Of 3,000 vectors a query reads some, by the bounds of their cells."""
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rnd.normal(0, 1, 16).astype(np.float32).tolist()) for i in range(3000)], "vec_id long, embedding array<float>")
    v = vafile.classes(vafile.integers(df), 6)
    grid = vafile.Grid(v)
    file = spark.createDataFrame([(r["class"], bytearray(grid.cells(grid.matrix([r["v"]])).tobytes())) for r in v.collect()], "class long, cells binary")
    q = grid.matrix([r["v"] for r in v.where("class % 50 = 0").orderBy("class").collect()])
    n = vafile.candidates(file, grid, q, np.arange(0, 3000, 50), 6).count()
    assert 6 * 60 <= n < 30 * 60


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert k == 4 or out.columns == docs.columns


# ---- near duplicates of the pipeline

def test_near_stage_links_through_fingerprint_trees(spark):
    """What the trees' radius leaves apart is no candidate, however alike the texts are; the plan's own radius links it."""
    rows = []
    for k in range(20):
        w = [f"t{k}w{i}" for i in range(140)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:130] + [f"t{k}x{i}" for i in range(10)]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    apart = [np.bitwise_count(np.array(simhash.fingerprint(a, 5, 2), np.uint64) ^ np.array(simhash.fingerprint(b, 5, 2), np.uint64)).sum() for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert 0 < min(apart) and max(apart) <= simhash.SIMILAR.radius
    assert {r["component_id"] for r in simhash.similar_groups(d, simhash.Alike(radius=0)).collect()} == set(range(40))
    middle = sorted(apart)[10]
    some = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(d, simhash.Alike(radius=int(middle))).collect()}
    assert [some[2 * k + 1] == 2 * k for k in range(20)] == [x <= middle for x in apart]
    assert {r["component_id"] for r in simhash.similar_groups(d).collect()} == set(range(0, 40, 2))


@pytest.mark.parametrize("shared", [4, 8, 20, 100, 400])
def test_radius_holds_alike_sets(shared):
    """Sets at a similarity of just 0.8 or more lie within the radius of the near stage."""
    rnd, plan = np.random.default_rng(shared), simhash.SIMILAR
    own = shared * plan.den // plan.num - shared
    for k in range(300):
        h = rnd.integers(0, 2**64, shared + own, np.uint64)
        left = k % (own + 1)
        a, b = np.r_[h[:shared], h[shared : shared + left]], np.r_[h[:shared], h[shared + left :]]
        differ = np.array(simhash.majority(a, plan.lanes), np.uint64) ^ np.array(simhash.majority(b, plan.lanes), np.uint64)
        assert np.bitwise_count(differ).sum() <= plan.radius


@pytest.mark.parametrize("radius", [4, 20, 54])
def test_trees_skip_what_is_linked(radius, monkeypatch):
    """Groups are those of all pairs at any radius, and near copies aren't compared with each other."""
    rnd = np.random.default_rng(radius)
    f = rnd.integers(0, 2**64, (60, 2), np.uint64)
    for _ in range(5):
        g = f[rnd.integers(0, len(f), 60)].copy()
        for _ in range(max(1, radius // 3)):
            g[np.arange(60), rnd.integers(0, 2, 60)] ^= np.uint64(1) << rnd.integers(0, 64, 60).astype(np.uint64)
        f = np.r_[f, g, g[:5]]
    group = np.sort(rnd.integers(0, 3, len(f)))
    label = np.arange(len(f))
    near = (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= radius) & (group[:, None] == group[None])
    while (low := np.where(near, label[None], len(f)).min(1)).tolist() != label.tolist():
        label = low
    assert simhash.linked(f, group, radius).tolist() == label.tolist()
    compared, apart = [], simhash._apart
    monkeypatch.setattr(simhash, "_apart", lambda f, a, b: compared.append(len(a)) or apart(f, a, b))
    copies = np.zeros((400, 2), np.uint64)
    copies[:, 0] = rnd.integers(0, 2 ** (radius // 2), 400, np.uint64)
    assert not simhash.linked(copies, np.zeros(400, int), radius).any() and sum(compared) < 20 * 400


def test_near_stage_cuts_large_shards(spark, monkeypatch):
    """Near copies that share many bands: groups are the same where their shards are cut into blocks."""
    rnd, rows = random.Random(3), []
    for k in range(60):
        w = [f"g{k % 3}w{i}" for i in range(200)]
        w[rnd.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "SHARD", 4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(d).collect()} == {k: k % 3 for k in range(60)}
