"""Statistics of experiment tables ``(model, graph, realization, step, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_models(runs: DataFrame, models: DataFrame) -> DataFrame:
    """``(run, model)``: the longest model name that occurs in the run name.

    Run names are cut into their substrings of the lengths that model names have, which turns
    the containment test into an equi-join. Ties take the later name; empty names match nothing.
    """
    names = models.select("model").where(F.length("model") > 0).distinct()
    lengths = names.agg(F.collect_set(F.length("model"))).scalar()  # as many as there are lengths
    sized = runs.select("run", F.explode(lengths).alias("len")).where(F.col("len") <= F.length("run"))
    starts = F.explode(F.sequence(F.lit(1), F.length("run") - F.col("len") + 1)).alias("start")
    parts = sized.select("run", "len", starts).select("run", F.substring("run", F.col("start"), F.col("len")).alias("model"))
    return parts.join(names, "model").groupBy("run").agg(
        F.max_by("model", F.struct(F.length("model"), F.col("model"))).alias("model")
    )


def two_level(values: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean over realizations, then mean and population deviation over graphs."""
    per_graph = values.groupBy(*keys, "graph").agg(F.avg(value).alias("m"))
    return per_graph.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def best_and_last(results: DataFrame, order: Sequence[str] = ("step",)) -> DataFrame:
    """Per realization: smallest value and value of the last step."""
    return results.groupBy("model", "graph", "realization").agg(
        F.min("value").alias("best"), F.max_by("value", F.struct(*order)).alias("last")
    )


def summary(results: DataFrame, order: Sequence[str] = ("step",)) -> DataFrame:
    """``(model, metric, mean, std)`` for the best and the last value."""
    ends = best_and_last(results, order)
    metric = F.explode(F.array(F.struct(F.lit("best").alias("metric"), F.col("best").alias("v")),
                               F.struct(F.lit("last").alias("metric"), F.col("last").alias("v")))).alias("e")
    rows = ends.select("model", "graph", "realization", metric).select("model", "graph", "realization", "e.*")
    return two_level(rows, "v", ["model", "metric"])


def curves(results: DataFrame, every: int = 1) -> DataFrame:
    """``(model, step, mean, std)`` for each kept step."""
    kept = results.where(F.col("step") % every == 0) if every > 1 else results
    return two_level(kept, "value", ["model", "step"])
