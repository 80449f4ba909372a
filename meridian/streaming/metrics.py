"""What streams report about their batches, as a table: observed metrics, late rows, state."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.shared import fresh_path

SCHEMA = "query string, batch long, at timestamp, source string, metric string, value double"


def _rows(progress) -> list[tuple]:
    """(query, batch, at, source, metric, value) of a batch's progress."""
    at = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
    found = [("input", "rows", progress.numInputRows)]
    for k, s in enumerate(progress.stateOperators):
        found += [(f"state-{k}", "late_rows", s.numRowsDroppedByWatermark), (f"state-{k}", "rows", s.numRowsTotal)]
    for name, row in progress.observedMetrics.items():
        found += [(name, metric, value) for metric, value in row.asDict().items() if value is not None]
    query = str(progress.name or progress.id)
    return [(query, progress.batchId, at, source, metric, float(value)) for source, metric, value in found]


class Recorder(StreamingQueryListener):
    """Writes each batch's metrics to a folder of the batch's number, so one that is run again takes its own place.

    Attach with spark.streams.addListener(recorder), take away with removeListener. Metrics
    of rows.observe() (sources.pings.tapped) are read where the rows pass; nothing is run
    a second time for them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "metrics")
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            p = event.progress
            lines = [json.dumps(dict(zip(("query", "batch", "at", "source", "metric", "value"), (q, b, at.isoformat(), s, m, v), strict=True))) for q, b, at, s, m, v in _rows(p)]
            # a few lines
            self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/run={p.runId}/n={p.batchId}")
        except Exception as e:  # a listener must not end the stream
            self.failed.append(repr(e))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        """(query, batch, at, source, metric, value) of what has been recorded."""
        lines = self.spark.read.option("recursiveFileLookup", "true").text(self.path)
        return lines.select(F.from_json("value", SCHEMA).alias("m")).select("m.*")


def late_rows(table: DataFrame) -> DataFrame:
    """(query, late): rows that each query has dropped behind its watermark."""
    return table.filter("metric = 'late_rows'").groupBy("query").agg(F.sum("value").cast("long").alias("late"))
