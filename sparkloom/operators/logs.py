"""System-call log lines: render, tokenise, type, filter.

A line is ``start end duration program host pid thread call return fd path word …``.
Batch and stream use the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.codes import DEFAULTS, SOCKET_TYPES, code_frame
from sparkloom.operators.ranking import global_rank

CLOCK_WRAP = 10000  # seconds are printed modulo this
COLUMNS = [  # stored name, type, 1-based token
    ("start_time", "double", 1), ("end_time", "double", 2), ("turnaround_time", "double", 3),
    ("proc_name", "string", 4), ("host_name", "string", 5), ("proc_id", "string", 6),
    ("thread_id", "string", 7), ("sys_call", "string", 8), ("return_byte", "int", 9),
    ("fd", "int", 10), ("pipe_val", "string", 11), ("contents", "string", 12),
]


def _word(words: Column, n: int) -> Column:
    return F.get(words, n - 1)


def clock(seconds: Column, nanos: Column) -> Column:
    """``seconds.nanoseconds`` with nine digits after the point."""
    return F.concat(seconds.cast("string"), F.lit("."), F.lpad(nanos.cast("string"), 9, "0"))


def render(df: DataFrame) -> Column:
    """Log line of a row with columns start_us, end_us, program, host, pid, thread, call,
    ret, fd, path and rest. The duration is printed with the original's borrow: a
    negative difference of nanoseconds is added to a second instead of taken from it.
    """
    def split_us(us: Column):
        return F.floor(us / 1000000) % CLOCK_WRAP, (us % 1000000) * 1000

    (s1, n1), (s2, n2) = split_us(F.col("start_us")), split_us(F.col("end_us"))
    borrow = n2 < n1
    seconds = F.when(borrow, s2 - s1 - 1).otherwise(s2 - s1)
    nanos = F.when(borrow, 1000000000 - (n2 - n1)).otherwise(n2 - n1)
    pid = F.col("pid").cast("string")
    pid = F.when(F.length(pid) < 5, F.lpad(pid, 5, "0")).otherwise(pid)
    width = F.greatest(F.lit(9), F.length(nanos.cast("string")))
    duration = F.concat(seconds.cast("string"), F.lit("."), F.lpad(nanos.cast("string"), width, F.lit("0")))
    return F.concat_ws(
        " ", clock(s1, n1), clock(s2, n2), duration, "program", "host", pid,
        F.lower(F.hex(F.col("thread"))), "call", F.col("ret").cast("string"),
        F.col("fd").cast("string"), "path", "rest",
    )


def tokenised(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.withColumn("words", text.tokens(F.col(line)))


def tail(words: Column) -> Column:
    """Free text after the fixed words, each word followed by a space; null if none.

    It starts at word 13 when word 11 is NON_SOCKET or word 9 is -1, else at word 16.
    """
    early = (F.coalesce(_word(words, 11) == "NON_SOCKET", F.lit(False))
             | F.coalesce(_word(words, 9) == "-1", F.lit(False)))
    first = F.when(early, 13).otherwise(16)
    rest = F.slice(words, first, F.greatest(F.size(words) - first + 1, F.lit(0)))
    return F.when(F.size(words) >= first, F.concat(F.array_join(rest, " "), F.lit(" ")))


def typed(lines: DataFrame, row_id: Column, line: str = "value") -> DataFrame:
    """Stored row of each line; words that are missing or not numbers become null."""
    parsed = tokenised(lines.select(row_id.alias("id"), F.col(line).alias("value")))
    cols = [
        (_word(F.col("words"), n) if kind == "string"
         else _word(F.col("words"), n).try_cast(kind)).alias(name)
        for name, kind, n in COLUMNS
    ]
    return parsed.select("id", *cols, F.lit("A").alias("valid"))


def numbered(lines: DataFrame, order_by: list[str]) -> DataFrame:
    """Give each line its arrival number from 0, counting every line."""
    return global_rank(lines, order_by, "id").withColumn("id", F.col("id") - 1)


def stable_id(line: Column) -> Column:
    """Identifier that depends on the line only, for streams without a global order."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")


def accepted(rows: DataFrame) -> DataFrame:
    """Rows to store: log files or closes, without socket descriptors."""
    wanted = F.coalesce(F.endswith(F.col("pipe_val"), F.lit(".log")), F.lit(False)) | F.coalesce(
        F.col("sys_call") == "close", F.lit(False)
    )
    socket = F.coalesce(F.col("pipe_val").isin(*SOCKET_TYPES.values(), DEFAULTS["socket"]), F.lit(False))
    return rows.where(wanted & ~socket)


def duration_check(rows: DataFrame) -> DataFrame:
    """Recompute the duration across the clock wrap and flag rows that disagree."""
    real = F.round((F.col("end_time") - F.col("start_time") + CLOCK_WRAP) % CLOCK_WRAP, 9)
    ok = F.abs(real - F.col("turnaround_time")) < 1e-6
    return rows.withColumn("duration", real).withColumn("turnaround_ok", ok)


def with_label(rows: DataFrame, code: str, kind: str, name: str) -> DataFrame:
    """Label of a numeric code, or the default for unknown codes."""
    labels = code_frame(rows.sparkSession, kind).select(
        F.col("code").alias(code), F.col("label").alias(name)
    )
    joined = rows.join(labels, code, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(DEFAULTS[kind])))


def report_lines(stored: DataFrame) -> DataFrame:
    """One printable line per stored row."""
    return stored.select(
        F.format_string("id = %d  proc_name = %s   thread_id = %s", "id", "proc_name", "thread_id")
        .alias("line")
    )
