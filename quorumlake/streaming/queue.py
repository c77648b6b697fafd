"""#158: the work queue as a stream with state: entries move a job on, and timers give back what is stuck."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumlake.streaming.ingest import MOST_CYCLES

FATE = "job_id long, status string, at long, ciclos long, desfecho string"
#: Times are microseconds, so that no time zone of a worker matters.
_JOB = "status string, at long, ciclos long"


class Reaper(StatefulProcessor):
    """Keeps a job's last entry and its cycles. A job that is being processed gets a timer; when event time passes it
    and nothing has come since, the job goes back, or fails after MOST_CYCLES.

    Entries of one time are taken in the order of their status, as in the batch form.
    """

    def __init__(self, stuck_minutes: int):
        self.stuck = stuck_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _JOB)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.job.get()
        last, cycles = ((held[1], held[0]), held[2]) if held else (None, 0)
        for r in rows:
            cycles += r["status"] == "processing"
            last = max(last, (r["at"], r["status"])) if last else (r["at"], r["status"])
        self.job.update((last[1], last[0], cycles))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last[1] == "processing":
            self.handle.registerTimer((last[0] + self.stuck) // 1000 + 1)
        yield Row(job_id=key[0], status=last[1], at=last[0], ciclos=cycles, desfecho=last[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, at, cycles = self.job.get()
        yield Row(job_id=key[0], status=status, at=at, ciclos=cycles, desfecho="failed" if cycles >= MOST_CYCLES else "pending")

    def close(self) -> None:
        pass


def fates(log: DataFrame, stuck_minutes: int = 30, late: str = "0 seconds") -> DataFrame:
    """(job_id, status, ts, ciclos, desfecho) of a stream log (job_id, status, ts), one row for each job that a batch moves on and for each that is given back.

    The session must keep state in RocksDB: spark.sql.streaming.stateStore.providerClass.
    """
    rows = log.where("job_id is not null and status is not null and ts is not null").select(F.col("job_id").cast("long").alias("job_id"), "status", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts"))
    out = rows.withWatermark("ts", late).groupBy("job_id").transformWithState(Reaper(stuck_minutes), FATE, "Update", "EventTime")
    return out.select("job_id", "status", F.timestamp_micros("at").alias("ts"), "ciclos", "desfecho")


PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
