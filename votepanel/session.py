"""Spark session and cluster-safety helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def get_session(master: str | None = None, app: str = "votepanel", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and local benches. On a cluster, pass the session you already have instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, as the session was launched with it.

    A session without the setting is accepted only in local mode (tests): it gets a scratch folder of its own. On a cluster a
    missing setting is an error, since a folder of one machine is not seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: launch the session with a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="votepanel-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of recomputing the joins) and, unlike
    ``Dataset.checkpoint``, computes the plan once (an eager RDD checkpoint evaluates it twice unless
    cached) and stores columns, not serialised rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def task_number(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Partitions for an exchange of ``rows`` rows: they grow with the rows, so that a task's memory does not; at least a task a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task))


def r6(c: Column | str) -> Column:
    """Report rounding to 6 decimals, half-up, identical in Spark and DuckDB (``round`` differs on ties)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)


def round_doubles(df: DataFrame) -> DataFrame:
    """Apply :func:`r6` to every double column (report step of the registered queries)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append(r6(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint folder for tables a job writes and reads back."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/derived/{name}-{uuid.uuid4().hex[:12]}"
