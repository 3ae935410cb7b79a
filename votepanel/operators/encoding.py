"""Categorical half of the preprocessing: most-frequent filling, ordinal codes and one-hot slots, with unseen values.

What is learned is a table: the levels of each column in order, their codes, and the value that fills nulls. Applying it is one
equi-join per column with its levels, so a column may have as many levels as it likes.

Defined results: nulls take the most frequent value (the smallest of equally frequent ones) and are then that level; a value not seen
in training has code -1 and no slot; a column without any value in training has no levels, and all its rows are unseen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_levels(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, level, code, slot, fill``: levels in order, their codes from 0 per column, their slots over all columns."""
    pairs = train.select(F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    counts = pairs.where("level is not null").groupBy("no", "column", "level").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("column")
    coded = counts.withColumn("code", F.row_number().over(own.orderBy("level")) - 1).withColumn("fill", F.first("level").over(own.orderBy(F.col("n").desc(), "level")))
    sizes = counts.groupBy("no").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("no", (F.sum("size").over(Window.orderBy("no")) - F.col("size")).alias("start"))  # a row a column
    return coded.join(F.broadcast(starts), "no").select("column", "level", "code", (F.col("start") + F.col("code")).cast("int").alias("slot"), "fill")


def encode(df: DataFrame, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``{c}_code`` for each column and ``slots``: the one-hot slots of the row, in the order of the columns."""
    fills = levels.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("fill"))).alias(f"_fill{i}") for i, c in enumerate(columns)])
    out = df.join(F.broadcast(fills), how="cross")  # one row
    for i, c in enumerate(columns):
        mine = levels.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("code").alias(f"_code{i}"), F.col("slot").alias(f"_slot{i}"))
        out = out.join(mine, F.coalesce(F.col(c).cast("string"), F.col(f"_fill{i}")) == F.col("_level"), "left").drop("_level")
    codes = {f"{c}_code": F.coalesce(F.col(f"_code{i}"), F.lit(-1)) for i, c in enumerate(columns)}
    out = out.withColumns(codes).withColumn("slots", F.array_compact(F.array(*[F.col(f"_slot{i}") for i in range(len(columns))])))
    return out.drop(*[f"_{n}{i}" for i in range(len(columns)) for n in ("fill", "code", "slot")])


def slots_vector(df: DataFrame, size: int, out: str = "onehot") -> DataFrame:
    """The slots as an ML vector of ``size`` entries (for models that need one; wide only where the levels are few)."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("slots", i).cast("double"))))
