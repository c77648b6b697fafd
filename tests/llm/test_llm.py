"""The training-data operators against brute force, round trips, held-out accuracy and hard cases."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import assert_same, connect
from quorumlake.llm import components, decontamination, language_id, packing, quality_fm, quality_rules, queries, repeats, secrets, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, Found string, blob string, th string"
LONG = "uma palavra qualquer e outra " * 4000
TEXT = "The quick committee of the agency met on the third day and heard the reports of all of its members in turn. " * 3


def hard(spark, more=()):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    texts = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, LONG), (None, TEXT), (None, None), (5, TEXT + "x"), (6, " \n\t"), (7, "token = abcdef12 token=x"), (7, "other"), (2**60 + 1, TEXT), *more]
    rows = [(k, t, None if k in (None, 3) else "en", None, None if k == 5 else len(t or ""), "s", "f", "b", None) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held(spark, table="documents", sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/{table}.parquet")


# ---- 7: SimHash

def slow_fingerprint(text, n=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(ids, fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        least[find(i)].append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("shard, once", [(20_000, 100_000), (3, 50)])
def test_fingerprints_and_groups(spark, docs, shard, once, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "_AT_ONCE", once)
    rows = hard(spark).unionByName(docs, allowMissingColumns=True)
    found = simhash.groups(rows, queries.OP7).select("doc_id", "th", "f0", "component_id").collect()
    source = rows.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in source]
    want = Counter((r["doc_id"], f, c) for r, f, c in zip(source, fps, slow_groups([r["doc_id"] for r in source], fps, 4)))
    assert Counter((r["doc_id"], r["f0"] % (1 << 64), r["component_id"]) for r in found) == want


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=60), st.integers(0, 6), st.randoms())
@settings(max_examples=30, deadline=None)
def test_bk_search_links_all(base, flips, rnd):
    for x in list(base):
        for _ in range(rnd.randrange(flips + 1)):
            x ^= 1 << rnd.randrange(64)
        base.append(x)
    f = np.array(sorted(set(base)), np.uint64).reshape(-1, 1)
    label = simhash.linked(f, np.zeros(len(f), int), 4)
    want = slow_groups(list(range(len(f))), [int(x) for x in f[:, 0]], 4)
    assert label.tolist() == want


def test_blocks_lose_no_pair():
    rnd, plan = random.Random(5), queries.OP7
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 4):
            b ^= 1 << bit
        keys = simhash.shard_keys(np.array([[a], [b]], np.uint64), plan)
        assert (keys[0] == keys[1]).any()


def test_near_dedup_keeps_one(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    base = [rnd.choice(words) for _ in range(300)]
    other = [rnd.choice(words) for _ in range(300)]
    near = base.copy()
    near[150] = "changed"
    rows = [(10, " ".join(base)), (10, " ".join(base)), (11, " ".join(near)), (3, " ".join(other)), (None, "lonely text of its own"), (12, None), (13, "")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, stay_th string")
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 10), (False, 12), (True, 0)]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_components_by_brute_force(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in parent}


# ---- 1, 10, 6: learned operators

def test_quality_scores(spark):
    d, lab = held(spark), held(spark, "labels")
    got = {r["doc_id"]: r for r in quality_fm.score(d, lab).collect()}
    assert len(got) == d.count()
    test = [(r["quality"], got[r["doc_id"]]) for r in lab.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(q == r["predicted"] for q, r in test) / len(test) > 0.93
    assert all(r["held_out"] == (crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for k, r in got.items())


def test_pairwise_term_is_the_double_sum():
    rnd = np.random.default_rng(0)
    rows = quality_fm.weighed([np.array([1, 5, 9, *(quality_fm.BUCKETS + k * quality_fm.BINS for k in range(12))])])
    m = quality_fm.Machine(0.3, rnd.normal(size=quality_fm.SIZE), rnd.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    i, x = rows.idx, rows.val
    want = 0.3 + (m.linear[i] * x).sum() + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert m.raw(rows)[0][0] == pytest.approx(want)


def test_learned_operators_take_hard_rows(spark, labels):
    rows = hard(spark)
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, None), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, one, labels.limit(0)):
        assert quality_fm.score(rows, lab).count() == rows.count()
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(rows, lab).collect())
    assert {r["score"] for r in quality_fm.score(rows, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.score(rows.limit(0), labels).count() == toxicity.score(rows.limit(0), labels).count() == language_id.identify(rows.limit(0)).count() == 0
    found = language_id.identify(rows).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (2, 3, 6))
    assert {r["lang_pred"] for r in language_id.identify(rows.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert quality_fm.keep_good(rows, labels).columns == rows.columns


def test_languages(spark):
    d = held(spark)
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    test = [r for r in language_id.identify(d).collect() if r["held_out"]]
    assert all(crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in test)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in test) / len(test) > 0.98


@pytest.mark.parametrize("n", [1, 2, 4, 6, 12])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
    assert not apart or min(apart) >= (1 if n == 2 else 2)


def test_toxicity(spark):
    d, lab = held(spark, sf="/root/testdata/sf0.1"), held(spark, "labels", "/root/testdata/sf0.1")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, lab).collect()}
    by = Counter((r["toxic"], got[r["doc_id"]]) for r in lab.collect())
    assert by[0, 1] <= 0.005 * (by[0, 0] + by[0, 1]) and by[1, 1] > 0.85 * (by[1, 0] + by[1, 1])


def test_chain_uses_earlier_links():
    rnd = np.random.default_rng(3)
    lists = [np.unique(rnd.integers(0, 50, 8)) for _ in range(600)]
    first = np.array([3 in x for x in lists], float)
    chain = toxicity.fit(toxicity.Rows.of(lists), np.column_stack([first, first]), ("a", "b"))
    p = chain.probabilities(toxicity.Rows.of(lists))
    assert ((p[:, 1] > 0.5) == first.astype(bool)).all() and chain.links[1].earlier[0] > 0.1


def test_toxicity_held_out(spark):
    """Fitted without every third label, whose rows it is then asked."""
    d, lab = held(spark, sf="/root/testdata/sf0.1"), held(spark, "labels", sf="/root/testdata/sf0.1")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    asked = lab.where(out)
    chain = toxicity.train(d, lab.where(~out))
    rows = d.join(asked, "doc_id").select("text", "toxic").collect()
    p = chain.probabilities(toxicity.Rows.of([toxicity.features(r["text"]) for r in rows]))[:, -1]
    y = np.array([r["toxic"] for r in rows])
    assert (p[y == 1] >= 0.5).mean() > 0.8 and (p[y == 0] < 0.5).mean() > 0.99


def test_chain_by_brute_force(docs, labels):
    """A row's probabilities, link by link and word by word."""
    chain = toxicity.train(docs, labels)
    texts = [r["text"] for r in docs.limit(30).collect()] + [None, "", "x"]
    got = chain.probabilities(toxicity.Rows.of([toxicity.features(t) for t in texts]))
    for t, p in zip(texts, got):
        words = {crc32(w.encode()) & (toxicity.BUCKETS - 1) for w in re.findall(r"[^\W\d_]+", (t or "").lower())} if t != "" else set()
        before = []
        for link in chain.links:
            z = link.bias + sum(w for k, w in zip(link.place.tolist(), link.words) if k in words) + sum(a * b for a, b in zip(link.earlier, before))
            before.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
        assert np.allclose(before, p)


def test_machine_by_brute_force():
    """A row's whole score with every pair of its features summed by itself."""
    rnd = np.random.default_rng(5)
    m = quality_fm.Machine(0.3, rnd.normal(0, 0.1, quality_fm.SIZE), rnd.normal(0, 0.2, (quality_fm.SIZE, quality_fm.RANK)))
    lists = [rnd.choice(quality_fm.SIZE, n, replace=False) for n in (0, 1, 2, 17)]
    values = [rnd.normal(0, 1, len(x)) for x in lists]
    got = m.score(quality_fm.Rows.of(lists, values))
    for x, v, g in zip(lists, values, got):
        z = m.bias + sum(m.linear[i] * a for i, a in zip(x, v))
        z += sum(float(m.factors[x[i]] @ m.factors[x[j]]) * v[i] * v[j] for i in range(len(x)) for j in range(i))
        assert np.isclose(g, 1 / (1 + np.exp(-z)))


def test_decoding_by_brute_force():
    """Every codeword's loss bit by bit, the least of which is the answer."""
    rnd = np.random.default_rng(6)
    names = list("abcd")
    x = rnd.normal(0, 1, (200, 30)).astype(np.float32)
    y = np.argmax(x[:, :4], axis=1)
    codes = language_id.fit(x, names, y)
    best, share = codes.predict(x[:20])
    for row, b, s in zip(x[:20], best, share):
        bits = [float(row @ codes.weights[:, k] + codes.bias[k]) for k in range(codes.code.shape[1])]
        loss = [sum(t * max(0.0, 1 - a * c) ** 2 for a, c, t in zip(bits, word, codes.trust)) / codes.trust.sum() for word in codes.code]
        p = np.exp(-8 * (np.array(loss) - min(loss)))
        assert b == int(np.argmin(loss)) and np.isclose(s, p[b] / p.sum(), atol=1e-4)
    assert (codes.predict(x)[0] == y).mean() > 0.8


def test_kinds_split_toxic_rows():
    lists = [np.array(x) for x in ([1, 2, 9], [1, 2], [1, 9], [5, 6], [5, 6, 9], [7], [7, 9])] * 6 + [np.array([9, k % 3 + 20]) for k in range(60)] + [np.array([], np.int64)]
    toxic = np.r_[np.ones(42), np.zeros(61)]
    found = toxicity.kinds(toxicity.Rows.of(lists), toxic)
    assert found[toxic == 0].sum() == 0 and (found[toxic == 1].sum(1) == 1).all()
    assert found.sum(0).tolist() == [18, 12, 12] and len({tuple(found[k]) for k in range(3)}) == 1
    assert toxicity.kinds(toxicity.Rows.of(lists[:2]), np.ones(2)).sum() == 0


# ---- 2: secrets

def test_secrets_match_sql(spark):
    con = connect("/root/testdata/sf0.01")
    assert_same(queries.op2_secret_scans(spark, "/root/testdata/sf0.01"), con, queries.oracle_sql()["op2_secret_scans"])


def test_secret_spans(spark):
    cases = {
        1: "token=abc secret: abcdef", 2: 'é PASSWORD = "hunter22" AKIA' + "A" * 16, 3: "a" * 24 + " " + "b" * 23, 4: None, 5: "", 6: "token = secret:abcdef", 7: "AKIAAKIA" + "1" * 13,
        8: "-----BEGIN RSA PRIVATE KEY-----", 9: "token=abc secret: abcdef",
    }
    rows = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    kinds = [r.kind for r in secrets.RULES]
    got = {r["doc_id"]: [(kinds[x["k"]], x["s"], x["e"]) for x in r["found"]] for r in secrets.scan(rows).collect()}

    def slow(text):
        out = []
        for k, r in enumerate(secrets.RULES):
            out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", re.A) if len(m[r.group]) >= r.least]
        return [(kinds[k], s, e) for s, k, e in sorted(out)]

    assert got == {k: slow(t) for k, t in cases.items()}
    assert got[1] == [("assign", 10, 24)] and got[6] == [("assign", 0, 14)]


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    first = spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, "x")], "doc_id long, text string")
    assert secrets.scan(first, ledger, secrets.BASE).where("size(found) = 1").count() == 2
    n = ledger.rows().count()
    assert n == 2 * len(secrets.BASE)
    secrets.scan(first, ledger, secrets.BASE).count()
    assert ledger.rows().count() == n
    newer = (*secrets.BASE[1:], secrets.Rule("assign", "password=([a-z]+)", version=2, group=1))
    found = secrets.scan(first.union(spark.createDataFrame([(4, "new")], first.schema)), ledger, newer).where("size(found) > 0")
    assert {r["doc_id"] for r in found.collect()} == {1, 2}
    assert ledger.rows().count() == n + 2 + 3


def test_a_small_run_reads_its_own_parts_of_the_ledger(spark, docs, tmp_path):
    """One blob's run reads one part, and of its rows the blob's alone are grouped."""
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    secrets.scan(docs.select("doc_id", "text"), ledger).count()
    assert len([p for p in os.listdir(tmp_path / "ledger") if p.startswith("part=")]) > 10
    one = secrets.versions(docs.limit(1)).select("blob")
    held = ledger.held(one)
    assert len({p.rsplit("/", 2)[1] for p in held.inputFiles()}) >= 1 and held.count() == 1
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"part#\d+ = \d+|part#\d+ IN", plan) or "PartitionFilters" in held._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_redaction(spark):
    rows = hard(spark)
    got = secrets.redact(rows)
    assert got.columns == rows.columns and got.count() == rows.count()
    assert [r["text"] for r in got.where("doc_id = 7").orderBy("text").collect()] == ["[SECRET] token=x", "other"]
    assert got.where("doc_id = 2").first()["text"] is None
    assert secrets.redact(rows.limit(0)).count() == 0


def test_a_second_run_moves_no_text(spark, tmp_path, monkeypatch):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = hard(spark).select("doc_id", "text")
    first = secrets.scan(rows, ledger).collect()
    files = set(os.listdir(tmp_path / "ledger"))

    def never(*_):
        raise AssertionError("a text was scanned again")

    monkeypatch.setattr(secrets, "spans", never)
    assert secrets.scan(rows, ledger).collect() == first
    assert set(os.listdir(tmp_path / "ledger")) == files
    monkeypatch.undo()
    more = rows.unionByName(spark.createDataFrame([(9, "AKIA" + "A" * 16)], rows.schema))
    unseen = ledger.unseen(secrets.versions(more))
    assert unseen.count() == 1
    # few unseen blobs are broadcast, and the filter by them comes before texts are dealt out
    plan = secrets.versions(more).groupBy("blob").agg(F.first("body")).join(unseen.select("blob"), "blob", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("BroadcastHashJoin") and "SortMergeJoin" not in plan
    assert secrets.scan(more, ledger).where("doc_id = 9 and size(found) = 1").count() == 1


def test_members_longer_than_a_split_take_linear_time():
    """Bytes read grow with the archive: each is read about once, however long a member is."""
    import gzip
    import io

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    rnd = random.Random(3)
    for mb in (3, 12):
        body = rnd.randbytes(mb << 20)
        whole = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        raw = gzip.compress(whole, 1) + gzip.compress(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx", 1)
        source, got = Counted(raw), []
        for start in range(0, len(raw), 1 << 20):
            got += [len(x) for _, x in warc.records(source, start, min(start + (1 << 20), len(raw)), len(raw))]
        assert got[0] == len(whole) and len(got) == 2
        # the splits inside the member look for a record, the first one reads the member
        assert source.read_bytes < 4 * len(raw)


def test_secrets_stay_in_the_jvm(spark, docs):
    plan = secrets.scan(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 3: decontamination

def distance_in(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(prev[j - 1] + (c != y), prev[j] + 1, now[-1] + 1))
        prev = now
    return min(prev)


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_matches_are_those_within_the_budget(seed):
    rnd = random.Random(seed)
    item = "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(10, 160)))
    item = decontamination.normal(item)
    bad = list(item)
    for _ in range(rnd.randrange(0, decontamination.budget(len(item)) + 4)):
        k = rnd.randrange(len(bad))
        bad[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
    text = decontamination.normal("".join(rnd.choice("abc ") for _ in range(rnd.randrange(80))) + "".join(bad) + " the end of it" * rnd.randrange(4))
    found = decontamination.Index.of([1], [item]).matches(text)
    if len(item) >= decontamination.Q:
        edits = distance_in(item, text)
        assert bool(found) == (edits <= decontamination.budget(len(item)))
        assert not found or min(h[3] for h in found) == edits


def test_leaks_in_the_table(spark):
    d, b = held(spark), held(spark, "benchmark")
    got = {r["doc_id"] for r in decontamination.contaminated(d, b).collect()}
    items = [decontamination.normal(r["text"]) for r in b.collect()]
    want = {r["doc_id"] for r in d.collect() if any(x in decontamination.normal(r["text"]) for x in items)}
    assert want and got == want
    assert {r["doc_id"] for r in d.collect()} - {r["doc_id"] for r in decontamination.clean(d, b).collect()} == want


def test_decontamination_of_hard_rows(spark):
    b = spark.createDataFrame([(1, TEXT), (2, None), (None, TEXT), (3, "short"), (1, TEXT)], "item_id long, text string")
    rows = hard(spark)
    assert Counter(r["doc_id"] for r in decontamination.contaminated(rows, b).collect()) == {1: 4, None: 2, 5: 2, 2**60 + 1: 2}
    assert decontamination.clean(rows, b).columns == rows.columns
    assert decontamination.contaminated(rows, b.limit(0)).count() == 0
    assert decontamination.contaminated(rows.limit(0), b).count() == decontamination.clean(rows.limit(0), b).count() == 0
    assert decontamination.clean(rows, b.limit(0)).count() == rows.count()


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_ITEM_CHARS", 50)
    b = spark.createDataFrame([(k, TEXT[k:]) for k in range(4)], "item_id long, text string")
    rows = hard(spark)
    assert {r["item_id"] for r in decontamination.contaminated(rows.where("doc_id = 1"), b).collect()} == {0, 1, 2, 3}
    monkeypatch.setattr(decontamination, "MAX_ITEM_CHARS", 1 << 20)
    once = decontamination.clean(rows, b).collect()
    monkeypatch.setattr(decontamination, "MAX_ITEM_CHARS", 50)
    in_blocks = decontamination.clean(rows, b)
    assert in_blocks.columns == rows.columns and Counter(in_blocks.collect()) == Counter(once) and len(once) == 7


def test_items_of_any_length(spark):
    text = "the zebra-crossing of Lyon, see zebras in a quagga herd; e4 e5 Nf3"
    items = ["a", "zebra", "zebras", "zebr", "e4 e5", "herd;", "", "  ", "of lyon,", "quagga her", "zebra-crossing of l", "x", "E4  E5 NF3", "ossing of"]
    want = {"a", "zebra", "zebras", "e4 e5", "herd;", "of lyon,", "quagga her", "zebra-crossing of l", "E4  E5 NF3"}
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame([(1, text), (2, "bar")], "doc_id long, text string")
    got = decontamination.contaminated(d, b).collect()
    assert {items[r["item_id"]] for r in got} == want and all(r["doc_id"] == 1 and r["edits"] == 0 for r in got)
    assert all(decontamination.normal(text)[r["start"] : r["end"]] == decontamination.normal(items[r["item_id"]]) for r in got)


# ---- 4: packing

@given(st.lists(st.integers(1, 100), max_size=120))
@settings(max_examples=60, deadline=None)
def test_bins_hold(sizes):
    n = np.array(sizes, np.int64)
    bins = packing.pack(n, 100)
    fills = np.bincount(bins, n) if len(n) else np.zeros(0)
    assert (fills <= 100).all() and (fills > 0).all()
    assert len(fills) <= max(1, int(np.ceil(n.sum() / 100 * 1.25))) + 1


def test_local_search_empties_bins():
    sizes = np.array([60, 30, 60, 30, 10, 10])
    assert len(packing.local_search([[0], [1], [2], [3], [4], [5]], sizes, 100)) == 2
    assert len(packing.local_search([[0], [1, 2]], np.array([50, 30, 30]), 110)) == 1


def test_sequences(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = hard(spark).unionByName(docs, allowMissingColumns=True)
    got = packing.pack_documents(rows).toPandas()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.LIMIT
    assert got["sequence_id"].nunique() <= got["length"].sum() / packing.LIMIT * 1.02 + 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % packing.LIMIT or packing.LIMIT if len(ids) > packing.LIMIT else len(ids)
        edges = [0, *range(head, len(ids) + 1, packing.LIMIT)]
        want.update((r["doc_id"], k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    key = lambda k: None if k != k else int(k)
    found = Counter((None if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces(rows).collect())
    assert found == want and key(float("nan")) is None
    assert packing.pack_documents(rows.limit(0)).count() == 0


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_both_encoders_agree(text):
    e = _encoder()
    assert e(text).tolist() == [*e.own.encode(text, add_special_tokens=False).ids, 0]


_made = []


def _encoder():
    if not _made:
        _made.append(packing.default_encoder())
    return _made[0]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "  x", " " * 3000 + "x", "ab" * 20000, "1²½", "can't WON'T it's", "\x1c\x85 a"])
def test_encoders_agree_on_odd_texts(text):
    test_both_encoders_agree.hypothesis.inner_test(text)


# ---- 5: rules

def slow_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat)


@given(st.text(alphabet="ab é\n\t#|\x0b\x1c\x85 ", max_size=80))
@settings(max_examples=200, deadline=None)
def test_stats_by_brute_force(text):
    assert quality_rules.stats(text)[:5] == slow_stats(text)


def test_rules(spark):
    d, lab = held(spark), held(spark, "labels")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    for r in d.collect():
        s = slow_stats(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == s
        assert g["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (g["base_failed"] and g["kept"])
    by = Counter((r["quality"], got[r["doc_id"]]["kept"]) for r in lab.collect() if not got[r["doc_id"]]["base_failed"])
    assert by[1, True] > 0.97 * (by[1, True] + by[1, False])
    rows = hard(spark)
    assert quality_rules.judge(rows).count() == rows.count() and quality_rules.judge(rows.limit(0)).count() == 0


def test_em_by_hand():
    post = quality_rules.expectation_maximisation({"++": 90, "+-": 5, "--": 20, "00": 1})
    assert post["++"] > 0.9 > 0.1 > post["--"] and quality_rules.expectation_maximisation({}) == {}


# ---- 8: WARC

def test_round_trip_matches_sql(spark):
    assert_same(queries.op8_warc(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), queries.oracle_sql()["op8_warc"])


PAGES = "page_id long, url string, html string, size string, path string"


@pytest.mark.parametrize("split", [1, 97, 1 << 20])
def test_splits_read_each_record_once(spark, split):
    body = "x\r\n\r\nWARC/1.1\r\n" * 3
    rows = [(1, "u", body), (2, None, body), (2, None, body), (3, "v", None), (4, "é\r\nx", ""), (None, "u", body), (5, "u", "é" * 5000), (None, None, "alone"), (2**60 + 1, "u", "y")]
    pages = spark.createDataFrame([(*r, "s", "p") for r in rows], PAGES).repartition(2)
    archives = warc.write(pages, least=1)
    got = Counter(tuple(r) for r in warc.read(archives, split).drop("path", "place").collect())
    digest = lambda t: warc.digest_of((t or "").encode())
    n = lambda t: len((t or "").encode())
    want = Counter()
    for k, _, t in rows:
        same = [a for a, _, b in rows if b == t and a is not None]
        top = max(same) if same and n(t) >= 1 and sum(b == t for _, _, b in rows) > 1 else None
        again = top is not None and k != top
        want[(k, n(t), digest(t), "revisit" if again else "response", top if again else None)] += 1
    assert got == want
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_reader_skips_false_magic(tmp_path):
    raw = b"junk" + warc.MAGIC + b"\x00" * 9 + warc.record("response", "1", "u", b"body", warc.digest_of(b"body"), None, "d") + b"\x1f\x8b\x08cut"
    with open(tmp_path / "a.gz", "wb") as f:
        f.write(raw)
    with open(tmp_path / "a.gz", "rb") as f:
        assert [warc.parse(r)[:2] for _, r in warc.records(f, 0, len(raw), len(raw))] == [("1", 4)]


@pytest.mark.parametrize("split", [997, 1 << 20])
def test_headers_of_any_length_are_read(spark, split):
    rnd = random.Random(3)
    urls = ["data:" + "".join(rnd.choices("0123456789abcdefghij", k=n)) for n in (16_000, 17_000, 100_000)] + ["data:" + "x" * 3_000_000]
    pages = spark.createDataFrame([(k, u, f"body {k}") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(4)
    found = warc.read(warc.write(pages), split)
    assert sorted(r["page_id"] for r in found.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("split", [1, 97])
def test_long_header_first_in_a_split(tmp_path, split):
    rnd = random.Random(4)
    urls = ["".join(rnd.choices("0123456789abcdefghij", k=n)) for n in (20_000, 10, 40_000)]
    raw = b"".join(warc.record("response", str(k), u, b"body", warc.digest_of(b"body"), None, "d") for k, u in enumerate(urls))
    with open(tmp_path / "a.gz", "wb") as f:
        f.write(raw)
    with open(tmp_path / "a.gz", "rb") as f:
        starts = [k for k in range(0, len(raw), split) if raw[k : k + split + 2].find(warc.MAGIC) >= 0]
        got = [warc.parse(r)[0] for k in starts for _, r in warc.records(f, k, min(k + split, len(raw)), len(raw))]
    assert got == ["0", "1", "2"]


def test_long_pages(spark):
    """Payloads and an archive beyond what the reader takes at a step."""
    rows = [(k, "http://h", random.Random(k).randbytes(n).hex()) for k, n in enumerate((3_000_000, 10, 1_500_000, 0))]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), split=400_000)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in got.collect()} == {k: (len(h), warc.digest_of(h.encode())) for k, _, h in rows}


@pytest.mark.parametrize("split", [1 << 24, 5000, 97])
def test_splits_are_tasks(spark, split):
    """Long headers, and a task for each split at most a few of its kind."""
    rows = [(k, f"http://h/{k}?" + "u" * (200_000 if k == 2 else 20_000 if k % 5 == 0 else 9), random.Random(k).randbytes(300).hex()) for k in range(12)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    found = warc.read(archives, split=split)
    assert sorted(r["page_id"] for r in found.collect()) == list(range(12))
    splits = sum(-(-r["size"] // split) for r in archives.collect())
    if split > 97:
        assert found.rdd.getNumPartitions() >= 0.6 * splits


# ---- 9: repeats

def slow_repeats(rows, length=400):
    seen = Counter()
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, x in raws:
        seen.update(x[i : i + length] for i in range(len(x) - length + 1))
    out = Counter()
    for k, x in raws:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(x)]
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out[(k, len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches, common, keys, wide", [(1, 10_000, 1 << 23, 250_000), (4, 10_000, 1 << 23, 250_000), (1, 1, 0, 40), (2, 2, 1 << 23, 300), (3, 10_000, 1 << 23, 60)])
def test_repeats_by_brute_force(spark, docs, batches, common, keys, wide, monkeypatch):
    monkeypatch.setattr(repeats, "COMMON", common)
    monkeypatch.setattr(repeats, "RANGE", wide)
    monkeypatch.setattr(repeats, "_AT_ONCE", 5000)
    monkeypatch.setattr(repeats, "FILTER_KEYS", keys)
    rnd = random.Random(7)
    passage = " ".join(str(rnd.random()) for _ in range(40))
    made = [(100, "a" + passage + "b"), (101, "c" + passage + "d"), (102, "ab" * 400), (103, passage[:399]), (104, passage[:400]), (105, "é" * 300 + passage[7:] + "é" * 300), (106, "z" * 401)]
    rows = hard(spark, made).drop("th").unionByName(docs.where("doc_id < 120"), allowMissingColumns=True)
    got = repeats.without_repeats(rows, batches=batches)
    want = slow_repeats([(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()])
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want
    assert repeats.without_repeats(rows.limit(0)).count() == 0


def test_long_texts_are_taken_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 700)
    rnd = random.Random(9)
    text = " ".join(str(rnd.random()) for _ in range(300))
    rows = [(1, text), (2, "x" * 333 + text[1000:2900] + "y" * 50), (3, text[2000:2399]), (4, "é" * 900), (None, text[100:900])]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=2)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == slow_repeats(rows)


def test_scratch_can_be_cleared(spark):
    from quorumlake.llm.shared import clear, drop_table, table

    one, two = table(spark.range(3).toDF("k"), "one"), table(spark.range(4).toDF("k"), "two")
    drop_table(one)
    files = [f.removeprefix("file://") for f in (*one.inputFiles(), *two.inputFiles())]
    assert [os.path.exists(f) for f in files].count(True) == len(two.inputFiles()) and two.count() == 4
    clear(spark)
    assert not any(map(os.path.exists, files))


def test_repeats_match_sql(spark):
    assert_same(queries.op9_suffix_array_dedup(spark, SF), connect(SF), queries.oracle_sql()["op9_suffix_array_dedup"])


def test_levels_merge_geometrically(spark, docs):
    from quorumlake.llm.shared import text_hash

    family = repeats.IndexFamily()
    rows = docs.select("doc_id", "text").withColumn("th", text_hash())
    ranks = []
    for k in range(5):
        family.add(rows.where(F.col("doc_id") % 5 == k))
        ranks.append([level.rank for level in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]
    assert family.merges == 3
    # a level holds each run once, and none is lost
    held = sum(level.array.count() for level in family.levels)
    different = [r for level in family.levels for r in level.array.select("lead", "gram", "run").distinct().collect()]
    assert held == sum(level.rows for level in family.levels) == len(different)
    assert set(different) == set(repeats.suffixes(rows).select("lead", "gram", "run").distinct().collect())


def test_batches_find_repeats_on_both_sides(spark):
    from quorumlake.llm.shared import text_hash

    rnd = random.Random(4)
    passage = " ".join(str(rnd.random()) for _ in range(60))
    rows = [(k, f"{k} " * 30 + (passage[k * 9 : 700 + k * 9] if k % 2 else "") + f" {k * k}" * 90) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", text_hash())
    family, found = repeats.IndexFamily(), defaultdict(set)
    for k in range(3):
        for r in family.repeats(df.where(F.col("doc_id") % 3 == k)).collect():
            found[r["doc_id"]] |= set(range(r["s"], r["e"]))
    want = {k: removed for k, _, removed, _, _ in slow_repeats(rows) if removed}
    assert {k: len(x) for k, x in found.items()} == want and len(want) >= 6


def test_a_level_is_met_where_it_lies(spark, docs, monkeypatch):
    """A scan moves the batch alone: a small batch moves little, whatever the level holds."""
    from quorumlake.llm.shared import text_hash

    monkeypatch.setattr(repeats, "RANGE", 100)
    family = repeats.IndexFamily()
    rows = docs.select("doc_id", "text").withColumn("th", text_hash())
    family.add(rows.where("doc_id % 40 <> 1"))
    level = family.levels[0].stored
    assert len(level.ids) > 5 and all(level.bounds[0][:-1] <= level.bounds[0][1:])
    plan = repeats.merge_scan(level, repeats.suffixes(rows.where("doc_id % 40 = 1")))._jdf.queryExecution().executedPlan().toString()
    held, asked = plan.split("+- Sort [range")[0], plan.split("+- Sort [range")[1]
    assert "Bucketed: true" in held and "Exchange" not in held and "Exchange" in asked


def test_ranks():
    rnd = random.Random(2)
    held = sorted((rnd.randrange(4), rnd.randrange(3), rnd.randrange(3)) for _ in range(60))
    keys = [(rnd.randrange(-1, 6), rnd.randrange(-1, 4), rnd.randrange(-1, 4)) for _ in range(200)]
    columns = lambda rows: [np.array(c) for c in zip(*rows)]
    for n in (1, 2, 3):
        for right in (False, True):
            want = [sum(h[:n] < k[:n] or (right and h[:n] == k[:n]) for h in held) for k in keys]
            assert repeats.ranks(columns(held)[:n], columns(keys)[:n], right).tolist() == want


def test_a_level_is_in_byte_order(spark, docs):
    from quorumlake.llm.shared import text_hash

    family = repeats.IndexFamily()
    rows = docs.select("doc_id", "text").withColumn("th", text_hash())
    for k in range(2):
        family.add(rows.where(F.col("doc_id") % 2 == k))
    raw = {r["doc_id"]: r["text"].encode() for r in rows.collect()}
    level = [(r["lead"] + (1 << 63), r["doc_id"], r["windows"] >> 32, r["windows"] & 0xFFFFFFFF) for r in family.levels[0].array.collect()]
    leads = [x for x, *_ in level]
    assert leads == sorted(leads)
    # the suffix starts in what all windows of its run have in common
    assert all(x.to_bytes(8, "big") in raw[k][j : i + repeats.LENGTH] for x, k, i, j in level)


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    start = held(spark).withColumn("Found", F.lit("x"))
    rows = start
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        if k < 4:
            assert out.columns == start.columns
            assert out.join(start.select("doc_id"), "doc_id", "left_anti").count() == 0
        rows = spark.createDataFrame(out.toPandas(), out.schema)
    good = {r["doc_id"] for r in held(spark, "labels").where("quality = 1").collect()}
    first = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, start, sf).collect()}
    assert len(good & first) > 0.97 * len(good)


def test_near_stage_by_brute_force(spark):
    """Of documents that share 0.8 of their five-word shingles or more, hardly a pair stays; of those
    that share few, none goes."""
    d = held(spark)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}

    def shingles(t):
        w = t.lower().split()
        return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) or frozenset([tuple(w)])

    s = {k: shingles(t) for k, t in texts.items()}
    kept = {r["doc_id"] for r in simhash.near_dedup(d).collect()}
    inverted = defaultdict(set)
    for k, x in s.items():
        for y in x:
            inverted[y].add(k)
    close, linked = 0, 0
    for k, x in s.items():
        for j in set().union(*(inverted[y] for y in x)) - {k}:
            share = len(x & s[j]) / len(x | s[j])
            if k < j and share >= 0.8:
                close += 1
                linked += not (k in kept and j in kept)
        if k not in kept:
            assert max(len(x & s[j]) / len(x | s[j]) for j in set().union(*(inverted[y] for y in x)) - {k}) > 0.5
    assert close and linked > 0.9 * close


def test_queries_run(spark):
    for name, f in queries.queries().items():
        df = f(spark, SF)
        assert df.count() > 0, name


def test_near_stage_links_by_exact_similarity(spark):
    """Pairs on either side of 0.8: at 116 of 145 shingles they link, at 115 of 146 they don't."""
    rows, want = [], set()
    for k in range(40):
        w = [f"t{k}w{i}" for i in range(135)]
        shared = 119 + k % 2
        near = w[:shared] + [f"t{k}x{i}" for i in range(134 - shared)]
        a, b = (set(zip(x, x[1:], x[2:], x[3:], x[4:])) for x in (w, near))
        want |= {2 * k} | (set() if len(a & b) >= 0.8 * len(a | b) else {2 * k + 1})
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
    assert 40 < len(want) < 80
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want


@pytest.mark.parametrize("group", [4_000_000, 700, 60])
def test_large_groups_of_near_copies(spark, group, monkeypatch):
    """A large group, chains that leave it step by step, and rows that meet it without a link."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(group)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.choice([0, 1, 58, 59])] = f"y{k}"
        rows.append(w)
    w = list(base)
    for k in range(12):
        w = w[3:] + [f"z{k}{i}" for i in range(3)]
        rows.append(list(w))
    rows += [base[:45] + [f"q{k}{i}" for i in range(10 + k)] for k in range(6)]
    sets = [set(zip(x, x[1:], x[2:], x[3:], x[4:])) for x in rows]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = simhash.similar_groups(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label)) and 1 < len(set(label)) < len(rows) / 2


@given(st.randoms(use_true_random=False))
@settings(max_examples=30, deadline=None)
def test_alike_by_brute_force(rnd):
    sets = [set(rnd.sample(range(40), rnd.randrange(0, 30))) for _ in range(12)]
    sets += [set(rnd.choice(sets)) ^ {rnd.randrange(40) for _ in range(rnd.randrange(4))} for _ in range(30)]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert simhash.alike([np.array(sorted(x), np.uint64) for x in sets], 4, 5).tolist() == label
