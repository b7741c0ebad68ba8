"""Text expressions for log lines and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE_MARK = "\x01"  # stands for a backslash until the cut is made


def neutralise_quotes(line: Column) -> Column:
    """Single quote, double quote and newline become a dot."""
    return F.translate(line, "'\"\n", "...")


def tokens(line: Column) -> Column:
    """Words separated by runs of spaces, as an array."""
    return F.filter(F.split(neutralise_quotes(line), " "), lambda w: w != "")


def clean_payload(text: Column, limit: int | None = None) -> Column:
    """Printable form of a payload, one output character per input byte.

    Carriage return, newline and tab become two-character escapes; every other byte
    outside 31..126 becomes a dot. ``limit`` is the size of the output buffer: the
    text stops before its last two places, but never inside an escape.
    """
    out = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    out = F.regexp_replace(out, "[^\\x1f-\\x7e\\r\\n\\t]", ".")
    for char, letter in (("\r", "r"), ("\n", "n"), ("\t", "t")):
        out = F.replace(out, F.lit(char), F.lit(_ESCAPE_MARK + letter))
    if limit is not None:
        cut = F.left(out, F.lit(max(limit - 2, 0)))
        out = F.when(F.endswith(cut, F.lit(_ESCAPE_MARK)), F.left(out, F.lit(limit - 1))).otherwise(cut)
    return F.replace(out, F.lit(_ESCAPE_MARK), F.lit("\\"))
