"""Streams: the item store, rounds, the queue with timers, rows of progress."""

import datetime
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from quorumlake.streaming import ingest, progress, queue, rounds, store

TS = datetime.datetime
ROW = "site string, hash string, ts timestamp"


def batch(spark, *rows):
    return spark.createDataFrame([("s", h, TS(2026, 1, d)) for h, d in rows], ROW)


def held(s):
    return {r["hash"]: (r["first_seen_at"].day, r["last_seen_at"].day) for r in s.read().collect()}


def files(path, name="*.parquet"):
    return {p: p.stat().st_size for p in pathlib.Path(path).rglob(name)}


def test_store_by_model(spark, tmp_path):
    """Eleven batches against a dictionary: alerts, merges, replays, and old runs that go."""
    s, model = store.ItemStore(spark, f"file://{tmp_path}", buckets=4, fanout=3), {}
    for k in range(11):
        rows = [(f"h{(k * 7 + i) % 13}", 1 + (k * 5 + i) % 28) for i in range(4)]
        new = {r["hash"] for r in s.apply(batch(spark, *rows), k).collect()}
        assert new == {h for h, _ in rows} - set(model)
        for h, d in rows:
            a, b = model.get(h, (d, d))
            model[h] = min(a, d), max(b, d)
        assert held(s) == model
        # the last batch again changes nothing and alerts alike; an earlier one says nothing
        before = files(tmp_path)
        assert {r["hash"] for r in s.apply(batch(spark, *rows), k).collect()} == new and files(tmp_path) == before
    assert not s.apply(batch(spark, ("h0", 1)), 3).count() and files(tmp_path) == before
    manifest = s.manifests.last()[1]
    assert sorted(r["level"] for r in manifest["runs"]) == [0, 0, 2] and len(list(pathlib.Path(tmp_path, "runs").iterdir())) <= len(manifest["runs"]) + len(manifest["gone"])


def test_a_small_batch_writes_little(spark, tmp_path):
    s = store.ItemStore(spark, f"file://{tmp_path}", buckets=4, fanout=4)
    big = spark.range(20_000).select(F.lit("s").alias("site"), F.md5(F.col("id").cast("string")).alias("hash"), F.lit(TS(2026, 1, 1)).alias("ts"))
    s.apply(big, 0)
    before = files(tmp_path)
    s.apply(batch(spark, ("x", 3)), 1)
    added = sum(n for p, n in files(tmp_path).items() if p not in before)
    assert added < sum(before.values()) / 50 and s.read().count() == 20_001


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = (store.ItemStore(spark, f"file://{tmp_path}", buckets=2) for _ in range(2))
    a.apply(batch(spark, ("a", 1)), 0)
    put = a.manifests.put
    # b is through while a is about to put its manifest
    a.manifests.put = lambda n, d: (b.apply(batch(spark, ("b", 2)), 1), put(n, d))[1]
    with pytest.raises(store.LateWriter):
        a.apply(batch(spark, ("c", 3)), 1)
    assert held(b) == {"a": (1, 1), "b": (2, 2)}
    assert len(list(pathlib.Path(tmp_path, "runs").iterdir())) == 2


def test_a_late_round_writes_nothing(spark, tmp_path):
    clock = [0.0]
    r = rounds.Rounds(spark, f"file://{tmp_path}/rounds", lambda: clock[0])
    s = store.ItemStore(spark, f"file://{tmp_path}/items", buckets=2)
    one = r.claim()
    assert one["verdict"] == "claimed" and r.current(one["fence"])
    assert r.claim()["verdict"] == "other_run" and r.claim(one["run"])["verdict"] == "no_token" and r.claim(one["run"], 1)["verdict"] == "in_flight"
    s.apply(batch(spark, ("a", 1)), 0, one["fence"])
    assert r.finish(one["fence"], ok=3) == "running"
    assert r.claim(one["run"], 0)["verdict"] == "stale_token"
    two = r.claim(one["run"], one["token"])
    clock[0] = 1000.0  # the run is silent for too long, another one takes over and writes
    three = r.claim()
    assert three["verdict"] == "claimed" and three["run"] != one["run"] and not r.current(two["fence"])
    s.apply(batch(spark, ("b", 2)), 1, three["fence"])
    before = files(tmp_path)
    with pytest.raises(store.LateWriter):
        s.apply(batch(spark, ("late", 3)), 2, two["fence"])
    assert r.finish(two["fence"]) == "late" and files(tmp_path) == before and set(held(s)) == {"a", "b"}
    assert r.finish(three["fence"], more=False) == "drained" and r.claim(three["run"], 1)["verdict"] == "closed"


def test_of_two_claims_one_wins(spark, tmp_path):
    a, b = (rounds.Rounds(spark, f"file://{tmp_path}") for _ in range(2))
    put, other = a.markers.put, []
    a.markers.put = lambda n, d: (other.append(b.claim()), put(n, d))[1]
    assert a.claim()["verdict"] == "other_run" and other[0]["verdict"] == "claimed"


def test_breaker(spark, tmp_path):
    assert not rounds.breaks(0, 7) and rounds.breaks(3, 5) and not rounds.breaks(4, 4)
    r = rounds.Rounds(spark, f"file://{tmp_path}")
    one = r.claim()
    assert r.finish(one["fence"], ok=1, failed=3) == "running"
    two = r.claim(one["run"], one["token"])
    assert r.finish(two["fence"], ok=1, failed=3) == "broken" and r.claim(one["run"], 2)["verdict"] == "closed"
    assert r.claim()["verdict"] == "claimed"


LOG = "job_id long, status string, ts timestamp"


def test_queue_has_the_fates_of_the_batch_form(spark, tmp_path):
    """Fed in two runs of the query, with a restart between: the last fates are those of the batch form."""
    rows = [
        (1, "queued", TS(2026, 1, 1, 0)), (1, "processing", TS(2026, 1, 1, 1)), (2, "processing", TS(2026, 1, 1, 5, 50)), *[(3, "processing", TS(2026, 1, 1, h)) for h in (1, 2, 3)],
        (4, "confirmed", TS(2026, 1, 1)), (5, "processing", TS(2026, 1, 1, 2)), (5, "confirmed", TS(2026, 1, 1, 2)), (6, "processing", TS(2026, 1, 1, 1)), (7, "queued", TS(2026, 1, 1, 6)),
    ]
    later = [(6, "confirmed", TS(2026, 1, 1, 7)), (2, "failed", TS(2026, 1, 1, 6, 5)), (8, "processing", TS(2026, 1, 1, 9)), (9, "queued", TS(2026, 1, 1, 10))]
    spark.conf.set(*queue.PROVIDER)
    landing, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

    def run():
        stream = queue.fates(ingest.source(spark, landing, LOG))
        put = lambda df, k: df.withColumn("k", F.lit(k)).write.mode("append").parquet(out)
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        # the fate by a timer comes with a later batch than the entry's
        last = spark.read.parquet(out).groupBy("job_id").agg(F.max_by("desfecho", F.struct("k", F.col("desfecho") != F.col("status"))).alias("d"))
        return {r["job_id"]: r["d"] for r in last.collect()}

    try:
        for part, n in ((rows, 6), (later, 10)):
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(landing)
            whole = spark.read.schema(LOG).parquet(landing)
            want = {r["job_id"]: r["desfecho"] for r in ingest.queue_state(whole, F.lit(TS(2026, 1, 1, n))).collect()}
            assert run() == want
        assert want == {1: "pending", 2: "failed", 3: "failed", 4: "confirmed", 5: "pending", 6: "confirmed", 7: "queued", 8: "pending", 9: "queued"}
    finally:
        spark.conf.unset(queue.PROVIDER[0])


def test_progress_rows(spark, tmp_path):
    """A row for each batch with its count, the error of a failed one, and the batch again when the query goes on."""
    p = progress.ProgressRows(spark, f"file://{tmp_path}/progress")
    spark.streams.addListener(p)
    landing, fail = f"file://{tmp_path}/in", [False]

    def each(df, k):
        df.count()
        if fail[0]:
            raise ValueError("no luck")

    def run():
        q = progress.observed(ingest.source(spark, landing, ROW), "items").writeStream.queryName("job").foreachBatch(each).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:  # noqa: BLE001
            assert fail[0]

    def rows(n):
        for _ in range(100):
            found = [r for r in p.read().collect()] if list(pathlib.Path(tmp_path).glob("progress/*.json")) else []
            if sum(r["status"] in ("ended", "failed") for r in found) == n:
                return found
            time.sleep(0.1)
        return found

    try:
        batch(spark, ("a", 1), ("b", 1)).coalesce(1).write.parquet(landing)
        run()
        rows(1)
        batch(spark, ("c", 1)).coalesce(1).write.mode("append").parquet(landing)
        fail[0] = True
        run()
        rows(2)
        fail[0] = False
        run()
        found = rows(3)
    finally:
        spark.streams.removeListener(p)
    done = sorted((r["batch"], r["input_rows"], r["counts"]) for r in found if r["status"] == "batch" and r["input_rows"])
    assert done == [(0, 2, '{"items": {"rows": 2}}'), (1, 1, '{"items": {"rows": 1}}')]
    assert [r["error"] is not None and "no luck" in r["error"] for r in found if r["status"] == "failed"] == [True]
