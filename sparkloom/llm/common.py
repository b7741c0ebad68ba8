"""Word rules and small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise

# Words are maximal runs without ASCII white space. Python's bytes.split() without
# arguments cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

LEARNING_REMAINDERS = (0, 2)  # crc32(doc_id as text) mod 3 of the rows models may learn from


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; that of no bytes, 0, for null."""
    return F.coalesce(F.crc32(text), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """True for rows no model may learn from. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def hash_share(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def running_sum(df: DataFrame, order_by: list[Column | str], value: str) -> DataFrame:
    """Add ``before``, the sum of ``value`` over all earlier rows, and ``total``, that over all.

    Rows are range-partitioned and sorted once and stored with their partition; sums run
    inside a partition, and only one row per partition meets in one task.
    """
    position = F.monotonically_increasing_id()
    ordered = materialise(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        .withColumn("__at", position).withColumn("__part", F.shiftright("__at", 33).cast("int")),
        "running",
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("__part").agg(F.sum(value).alias("__sum")).select(
        "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__sum").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "__part")
        .withColumn("before", F.col("__offset") + F.col("__inside"))
        .drop("__at", "__part", "__inside", "__offset")
    )
