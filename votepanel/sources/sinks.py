"""Report sinks: one-row metric tables to long (metric, value) JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_long(metrics: DataFrame) -> DataFrame:
    cols = [c for c in metrics.columns]
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return metrics.select(F.expr(f"stack({len(cols)}, {stack}) as (metric, value)"))


def write_metrics(metrics: DataFrame, path: str) -> str:
    """Write a metric table as JSON lines and Parquet (long format), return the folder."""
    long_ = metrics_long(metrics).coalesce(1)
    long_.write.mode("overwrite").json(f"{path}/json")
    long_.write.mode("overwrite").parquet(f"{path}/parquet")
    return path
