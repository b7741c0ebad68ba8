"""Continuous ingestion of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import logs
from sparkloom.sources.tables import stream_location


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they arrive, column ``value``."""
    folder, pattern = stream_location(spark, path)
    return spark.readStream.option("pathGlobFilter", pattern).text(folder)


def ingest(lines: DataFrame, target: str, **trigger) -> StreamingQuery:
    """Store every line as text and the accepted ones as typed rows.

    Each batch overwrites its own folders, so a replay after a failure neither
    loses nor repeats rows. Pass ``availableNow=True`` to drain and stop.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.select("value").write.mode("overwrite").text(f"{target}/raw/batch={batch_id}")
            rows = logs.typed(batch, logs.stable_id(F.col("value")))
            logs.accepted(rows).write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def stored_rows(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/rows").drop("batch")
