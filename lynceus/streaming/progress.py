"""What streams have done, batch by batch, as a table."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, name string, batch long, at string, rows_read long, rows_written long, ms long, state_rows long, late_rows long"


class ProgressTable(StreamingQueryListener):
    """Writes a line for each batch of the session's streams to a folder; a batch that is told twice is one line.

    with ProgressTable(spark, path) as progress: ... run streams ...; progress.table() has what was told until then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended, self._begun, self._lock = set(), set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._begun.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators or []
        row = {
            "query": str(p.id), "run": str(p.runId), "name": p.name, "batch": p.batchId, "at": p.timestamp, "rows_read": p.numInputRows, "rows_written": max(p.sink.numOutputRows, 0), "ms": p.batchDuration,
            "state_rows": sum(s.numRowsTotal for s in state), "late_rows": sum(s.numRowsDroppedByWatermark for s in state),
        }
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.runId}-{p.batchId}.json")
        out = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(jpath, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def __enter__(self) -> ProgressTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        """Waits for what the streams that have begun still tell, at most ten seconds after they have ended."""
        limit = time.monotonic() + 10
        with self._lock:
            while self._begun - self._ended and time.monotonic() < limit:
                self._lock.wait(0.2)
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        """One row a batch; empty without batches."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.path)
