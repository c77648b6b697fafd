"""Incremental ingest as Structured Streaming: poll-and-diff items, a work queue with reapers, backfill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quorumlake.streaming.store import ItemStore


def source(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder; the checkpoint of a query is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_ingest(items: DataFrame, store: ItemStore, checkpoint: str, alert: Callable[[DataFrame, int], None] | None = None, fence: int = 0) -> StreamingQuery:
    """Takes all that is there, batch by batch, and stops (#159, #163). A writer of an earlier fence than the store's fails."""

    def each(batch: DataFrame, batch_id: int) -> None:
        new = store.apply(batch, batch_id, fence)
        if alert:
            alert(new, batch_id)

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_items(items: DataFrame, late: str = "2 days") -> DataFrame:
    """#157: each (site, hash) once, within a watermark that bounds the state."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(["site", "hash"])


def windowed_counts(items: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Items per site and window, late ones up to the watermark."""
    return items.withWatermark("ts", late).groupBy(F.window("ts", width), "site").agg(F.count("*").alias("n"))


#: Cycles after which a document is given up.
MOST_CYCLES = 3


def queue_state(log: DataFrame, now, stuck_minutes: int = 30) -> DataFrame:
    """#158: the state of each job from an append-only log (job_id, status, ts): the last entry
    (of one time that of the greatest status), how often it was taken up, and what the reaper does: stuck ones go back until MOST_CYCLES, then fail."""
    last = log.groupBy("job_id").agg(F.max(F.struct("ts", "status")).alias("m"), F.count_if(F.col("status") == "processing").alias("ciclos"))
    last = last.select("job_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"), "ciclos")
    stuck = (F.col("status") == "processing") & (F.col("ts") < now - F.expr(f"INTERVAL {stuck_minutes} MINUTES"))
    fate = F.when(stuck & (F.col("ciclos") >= MOST_CYCLES), "failed").when(stuck, "pending").otherwise(F.col("status"))
    return last.select("job_id", "status", "ts", "ciclos", fate.alias("desfecho"))
