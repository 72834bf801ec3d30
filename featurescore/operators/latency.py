"""Latency summaries: mean and the elements at n/2 and floor(0.99 n) of the sorted values (0-based)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import index_percentiles

#: Shares of the sorted values before the reported elements.
SHARES = {"p50": 0.5, "p99": 0.99}


def latency_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys.., n, avg, p50, p99), exact; no key is sorted in one task (see index_percentiles)."""
    return index_percentiles(df, keys, value, SHARES)


def latency_metrics(summary: DataFrame, keys: list[str]) -> DataFrame:
    """A summary as metric rows (keys.., metric, value, unit)."""
    return summary.select(*keys, F.expr("stack(3, 'Latency_Avg', avg, 'Latency_P50', p50, 'Latency_P99', p99) AS (metric, value)"), F.lit("Milliseconds").alias("unit"))


def tumbling(df: DataFrame, ts: str, width: str) -> DataFrame:
    """df with the start of the tumbling window of each row."""
    return df.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), width)["start"])
