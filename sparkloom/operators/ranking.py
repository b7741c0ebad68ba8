"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise

_LOCAL_BITS = 33  # low bits of monotonically_increasing_id: position in the partition


def global_rank(df: DataFrame, order_by: list[Column | str], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the total order ``order_by``.

    The rows are range-partitioned and sorted once, and stored with their
    position inside the partition. Only one row count per partition goes through
    the window that turns counts into offsets. ``order_by`` should be unique.
    """
    slot = F.monotonically_increasing_id()
    ordered = materialise(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("__slot", slot)
        .withColumn("__part", F.shiftright("__slot", _LOCAL_BITS).cast("int")),
        "ranked",
    )
    # at most one row per range partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("__part")
        .agg(F.count("*").alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    local = F.col("__slot").bitwiseAND(F.lit(2**_LOCAL_BITS - 1))
    return (
        ordered.join(offsets, "__part")
        .withColumn(name, (F.col("__offset") + local + 1).cast("bigint"))
        .drop("__part", "__slot", "__offset")
    )
