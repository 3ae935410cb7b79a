"""Incremental ingest of result files as they are published (Structured Streaming).

A results folder is a file stream: each new file is standardised with the same DataFrame functions as
the batch ingest and appended to the long table (Parquet, partitioned by election type and year). The
file sink plus the checkpoint in the shared checkpoint folder give exactly-once output across restarts
and executor loss; ``availableNow`` processes what has arrived and stops (cron-style runs).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from votepanel.session import ensure_checkpoint_dir
from votepanel.sources import delimited as DL


def raw_schema(columns: list[str]) -> StructType:
    """File streams need a schema up front: every raw column as a string (typed after harmonising)."""
    return StructType([StructField(c, StringType(), True) for c in columns])


def standardise_stream(df: DataFrame, meta: Mapping[str, object]) -> DataFrame:
    """Streaming-safe part of :func:`votepanel.sources.delimited.standardise_election` (no header sniffing)."""
    df = df.toDF(*[DL.repair_label(c) for c in df.columns])
    df = DL.rename_by_label(df, meta.get("rename_map", {}))  # type: ignore[arg-type]
    df = DL.add_event_metadata(df, meta)
    df = DL.build_station_key(df, list(meta.get("code_bv_cols", [])), widths=meta.get("code_bv_widths"))  # type: ignore[arg-type]
    df = DL.ensure_columns(df)
    df = DL.coerce_numeric(df, decimal=str(meta.get("decimal", ",")))
    return DL.order_columns(DL.basic_cleaning(df))


def start_results_stream(
    spark: SparkSession,
    source_dir: str,
    columns: list[str],
    sink_dir: str,
    meta: Mapping[str, object],
    *,
    encoding: str = "ISO-8859-1",
    checkpoint_location: str | None = None,
    max_files_per_trigger: int = 64,
    available_now: bool = True,
):
    """Start the stream; returns the ``StreamingQuery`` (call ``awaitTermination()`` for availableNow)."""
    ckpt = checkpoint_location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/results"
    raw = (
        spark.readStream.schema(raw_schema(columns)).option("sep", str(meta.get("sep", ";"))).option("header", True)
        .option("encoding", encoding).option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir)
    )
    std = standardise_stream(raw, meta).withColumn("source_file", F.input_file_name())
    # a file re-published under the same name is one file for the stream source (it tracks paths)
    writer = (
        std.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
        .partitionBy("type_scrutin", "annee").outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
