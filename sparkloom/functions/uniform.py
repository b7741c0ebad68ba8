"""Reproducible uniform draws: one number per (seed, row, purpose)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_HEX_DIGITS = 13


def draw_key(seed: int, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part…``, the same text in every engine."""
    cols = [F.lit(str(seed))]
    cols += [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def uniform(seed: int, *parts: Column | str) -> Column:
    """Double in [0, 1) from the first 52 bits of :func:`draw_key`."""
    head = F.substring(draw_key(seed, *parts), 1, DRAW_HEX_DIGITS)
    # never null; saying so stops the optimizer from testing the whole expression for it
    number = F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(0.0))
    return number / F.lit(float(2 ** (4 * DRAW_HEX_DIGITS)))


def uniform_sql(seed: int, *parts: str) -> str:
    """The same draw as a DuckDB expression; ``parts`` are SQL expressions."""
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5({text}), 1, {DRAW_HEX_DIGITS})) AS BIGINT) / {2 ** 52}.0::DOUBLE)"
