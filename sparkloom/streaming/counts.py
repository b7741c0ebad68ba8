"""Incremental fitting from a stream: counts per micro-batch, merged on read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.counts import family_counts, merge_counts
from sparkloom.operators.network import Network
from sparkloom.sources.tables import stream_location
from sparkloom.session import materialise, new_path


def fit_stream(
    spark: SparkSession,
    path: str,
    label: Callable[[DataFrame], DataFrame],
    net: Network,
    target: str | None = None,
) -> DataFrame:
    """Count the files under ``path`` as a stream and return the merged counts.

    Each batch overwrites its own folder, so a batch that is replayed after a
    failure is not counted twice. With the same ``target`` a later call continues
    where the last one stopped.
    """
    target = target or new_path(spark, "stream-counts")
    schema = spark.read.parquet(path).schema
    folder, pattern = stream_location(spark, path)

    def count(batch: DataFrame, batch_id: int) -> None:
        family_counts(label(batch), net).write.mode("overwrite").parquet(
            f"{target}/counts/batch={batch_id}"
        )

    (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
        .writeStream.foreachBatch(count)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    stored = spark.read.parquet(f"{target}/counts").drop("batch")
    return materialise(merge_counts(stored), "counts")
