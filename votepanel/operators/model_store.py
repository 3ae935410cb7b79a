"""Models in a shared folder, with the names of their features, and frames aligned to those names before scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_pipeline(model: PipelineModel, features: Sequence[str], path: str) -> None:
    """A Spark ML pipeline and its feature names, in order."""
    model.write().overwrite().save(f"{path}/model")
    _save_features(SparkSession.active(), features, path)


def load_pipeline(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    return PipelineModel.load(f"{path}/model"), load_features(spark, path)


def save_ridge(models: DataFrame, features: Sequence[str], path: str) -> None:
    """The table of ridge models of ``operators.gram``."""
    models.write.mode("overwrite").parquet(f"{path}/model")
    _save_features(models.sparkSession, features, path)


def load_ridge(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    return spark.read.parquet(f"{path}/model"), load_features(spark, path)


def _save_features(spark: SparkSession, features: Sequence[str], path: str) -> None:
    spark.createDataFrame(list(enumerate(features)), "no int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_features(spark: SparkSession, path: str) -> list[str]:
    """Feature names in the order of training (as many rows as the model has columns)."""
    return [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("no").collect()]


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` (missing ones are left out) and then the features in their order as doubles: missing ones null, others gone."""
    have = set(df.columns)
    cols = [F.col(f"`{c}`") for c in keep if c in have and c not in features]
    return df.select(*cols, *[(F.col(f"`{c}`").try_cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in features])
