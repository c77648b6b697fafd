"""A log-structured table of items: a batch appends what it saw, readers merge, and runs of like size are merged
geometrically, so that a batch writes in proportion to itself."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.sources.markers import Markers

#: Parts of keys by hash, and runs of a level that make one of the next.
BUCKETS, FANOUT = 32, 4
ITEM = "site string, hash string, first_seen_at timestamp, last_seen_at timestamp, new boolean"


class LateWriter(Exception):
    """The store has moved on to a later fence, or another writer was first."""


def merged(rows: DataFrame) -> DataFrame:
    """#174: one row per (site, hash) with the first and the last sight."""
    return rows.groupBy("site", "hash").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


class ItemStore:
    """#157, #163, #174: items by (site, hash) with the first and the last sight.

    A run is a folder of rows, in parts by key hash. A manifest lists the runs that count, with the last batch
    and the fence of its writer; it is replaced by the next one in a single step. A batch that is replayed writes
    nothing. Of two writers to the same manifest one wins, and one with an earlier fence than the manifest's is refused. Runs that
    are merged go one manifest later, so that whoever reads by the last manifest still finds them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path.rstrip("/"), buckets, fanout
        self.manifests = Markers(spark, f"{self.path}/manifest")

    def _bucket(self):
        return F.pmod(F.xxhash64("site", "hash"), F.lit(self.buckets)).cast("int")

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{ITEM}, bucket int").parquet(f"{self.path}/runs/{name}")

    def _runs(self, manifest: dict) -> DataFrame | None:
        found = [self._run(r["name"]) for r in manifest.get("runs", [])]
        return reduce(DataFrame.unionByName, found) if found else None

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/runs/{name}")
        return name

    def _drop(self, name: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def read(self) -> DataFrame | None:
        """The items, merged over the runs; None before the first batch."""
        rows = self._runs(self.manifests.last()[1])
        return None if rows is None else merged(rows)

    def apply(self, batch: DataFrame, batch_id: int, fence: int = 0) -> DataFrame:
        """Takes a batch (site, hash, ts) and returns the items that are new in it, the alerts.

        Batches come in the order of their numbers. The last one, replayed, gives its alerts again; earlier ones
        give none.
        """
        number, manifest = self.manifests.last()
        if fence < manifest.get("fence", 0):
            raise LateWriter(f"fence {fence} is behind {manifest['fence']}")
        if batch_id <= manifest.get("batch", -1):
            return self._alerts(manifest, batch_id)
        own = batch.groupBy("site", "hash").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
        name = self._write(self._seen(own, manifest))
        runs, gone = self._compact([*manifest.get("runs", []), {"name": name, "level": 0}])
        after = {"runs": runs, "batch": batch_id, "fence": fence, "delta": name, "gone": gone}
        if not self.manifests.put(number + 1, after):
            for r in runs:
                if r not in manifest.get("runs", []):
                    self._drop(r["name"])
            self._drop(name)
            raise LateWriter(f"manifest {number + 1} is another writer's")
        for old in manifest.get("gone", []):
            self._drop(old)
        return self._alerts(after, batch_id)

    def _seen(self, own: DataFrame, manifest: dict) -> DataFrame:
        """own with new: whether no run holds the key. Only parts that the batch touches are read."""
        held = self._runs(manifest)
        if held is None:
            return own.withColumn("new", F.lit(True))
        touched = [r[0] for r in own.select(self._bucket()).distinct().collect()]  # one number a part at most
        held = held.where(F.col("bucket").isin(touched)).select("site", "hash", F.lit(True).alias("held"))
        known = held.join(own.select("site", "hash"), ["site", "hash"], "left_semi").distinct()
        return own.join(known, ["site", "hash"], "left").select(*own.columns, F.col("held").isNull().alias("new"))

    def _compact(self, runs: list[dict]) -> tuple[list[dict], list[str]]:
        """Runs after merging: fanout of a level become one of the next; and the names of those that went into it."""
        gone: list[str] = []
        while True:
            level = max((k for k in {r["level"] for r in runs} if sum(r["level"] == k for r in runs) >= self.fanout), default=None)
            if level is None:
                return runs, gone
            some = [r for r in runs if r["level"] == level]
            rows = merged(reduce(DataFrame.unionByName, [self._run(r["name"]) for r in some]))
            new = {"name": self._write(rows.withColumn("new", F.lit(False))), "level": level + 1}
            gone += [r["name"] for r in some]
            runs = [r for r in runs if r not in some] + [new]

    def _alerts(self, manifest: dict, batch_id: int) -> DataFrame:
        rows = self._run(manifest["delta"]) if batch_id == manifest["batch"] else self.spark.createDataFrame([], f"{ITEM}, bucket int")
        return rows.where("new").select("site", "hash", "first_seen_at", "last_seen_at")
