"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def stream_location(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, file pattern) for a file stream, whether ``path`` is a file or a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(hadoop).isFile():
        return path.rsplit("/", 1)[0], path.rsplit("/", 1)[1]
    return path, "*"
