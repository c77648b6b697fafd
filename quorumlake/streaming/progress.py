"""#165: progress of streaming jobs as rows: what each batch observed, and how a query ended."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

ROW = "job string, run string, batch long, status string, input_rows long, counts string, error string, at string"


def observed(rows: DataFrame, name: str = "job") -> DataFrame:
    """rows, with their number observed under a name."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


class ProgressRows(StreamingQueryListener):
    """Writes a small JSON document for every batch and for the end of every query; `read` gives them as rows.

    A batch that failed has no progress of its own; the end of its query has the error, and the batch that
    replaces it in the next run has a row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, row: dict) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        out = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        self._put({"job": event.name, "run": str(event.runId), "status": "started", "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {k: r.asDict() for k, r in p.observedMetrics.items()}
        self._put({"job": p.name, "run": str(p.runId), "batch": p.batchId, "status": "batch", "input_rows": p.numInputRows, "counts": json.dumps(counts), "at": p.timestamp})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put({"run": str(event.runId), "status": "failed" if event.exception else "ended", "error": event.exception})

    def read(self) -> DataFrame:
        return self.spark.read.schema(ROW).json(self.path)
