"""Costs of micro-batches: what a streaming query reports about itself, as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

COSTS = "batch long, rows long, milliseconds long, rows_per_second double, started string"


def batch_costs(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row for each recent micro-batch (as many as spark.sql.streaming.numRecentProgressUpdates keeps)."""
    rows = []
    for p in query.recentProgress:
        p = json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p)
        rows.append((p["batchId"], p["numInputRows"], p.get("durationMs", {}).get("triggerExecution"), float(p.get("processedRowsPerSecond") or 0), p["timestamp"]))
    return spark.createDataFrame(rows, COSTS)


def save_costs(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    batch_costs(spark, query).write.mode("append").parquet(path)
