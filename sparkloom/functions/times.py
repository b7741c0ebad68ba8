"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a timestamp without zone is read as UTC."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name))
    gap = F.col(name) - F.lit("1970-01-01").cast("timestamp_ntz")
    whole = [F.extract(F.lit(unit), gap).cast("bigint") for unit in ("DAY", "HOUR", "MINUTE")]
    minutes = (whole[0] * 24 + whole[1]) * 60 + whole[2]
    micros = (F.extract(F.lit("SECOND"), gap) * 1000000).cast("bigint")
    return minutes * 60000000 + micros
