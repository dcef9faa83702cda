"""Totals of runs: stage durations, model usage, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_metrics(stages: DataFrame) -> DataFrame:
    """run, n_stages and total_ms from stages (run, stage, duration_ms); missing durations count as 0."""
    return stages.groupBy("run").agg(F.count("*").alias("n_stages"), F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("total_ms"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Per run and kind of call: calls, errors and tokens, from calls (run, kind, ok, prompt_tokens, completion_tokens)."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return calls.groupBy("run", "kind").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), n("prompt_tokens").alias("prompt_tokens"), n("completion_tokens").alias("completion_tokens"),
        (n("prompt_tokens") + n("completion_tokens")).alias("total_tokens"),
    )
