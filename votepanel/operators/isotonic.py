"""Isotonic calibration by pooling adjacent violators, with partial pooling before the shuffle.

Predictions are first put on a grid of 10^-DIGITS and rows with one grid value become one point (weights and weighted truths
summed), so a group has at most 10^DIGITS + 1 points, however many rows it holds: predictions are shares in [0, 1]. Points are cut into ranges of
(group, value); each range pools its own adjacent violators, which is part of the final pooling, as violators may be pooled in any
order. What the ranges are left with is pooled once more, group by group, over these bounded lists. The map of a group is linear
between the ends of its blocks and constant outside, and it is evaluated once per distinct value to be calibrated; rows meet
their calibrated value by an equi-join.

Defined results: rows without prediction, truth or positive weight are not fitted; predictions beyond [0, 1] count at its ends; groups with
under ``min_rows`` fitted rows leave their predictions as they are; null predictions stay null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def grid(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 10**DIGITS).cast("long"))


def pool(blocks: list[list], block: list) -> None:
    """Append a block ``[low, high, weight, weighted truth, rows]`` and pool while the last mean is not above the one before it."""
    blocks.append(block)
    while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
        last = blocks.pop()
        before = blocks[-1]
        before[1] = last[1]
        for k in (2, 3, 4):
            before[k] += last[k]


_BLOCKS = "g string, low long, high long, w double, wy double, n long"


def _pool_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted points of a range -> its pooled blocks."""

    def out(group: str, blocks: list[list]) -> pa.RecordBatch:
        low, high, w, wy, n = zip(*blocks, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([group] * len(low)), pa.array(low), pa.array(high), pa.array(w), pa.array(wy), pa.array(n)], names=["g", "low", "high", "w", "wy", "n"])

    group, blocks = None, []
    for batch in batches:
        for g, low, high, w, wy, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                if blocks:
                    yield out(group, blocks)
                group, blocks = g, []
            pool(blocks, [low, high, w, wy, n])
    if blocks:
        yield out(group, blocks)


def interpolate(blocks: list[list], values: list[int]) -> list[float]:
    """The isotonic map at sorted grid values."""
    out, k = [], 0
    for v in values:
        while k < len(blocks) and blocks[k][1] < v:
            k += 1
        if k == len(blocks):
            out.append(blocks[-1][3] / blocks[-1][2])
            continue
        low, high = blocks[k][0], blocks[k][3] / blocks[k][2]
        if v >= low or k == 0:
            out.append(high)
        else:
            x, y = blocks[k - 1][1], blocks[k - 1][3] / blocks[k - 1][2]
            out.append(y + (high - y) * (v - x) / (low - x))
    return out


def _maps(min_rows: int):
    """Sorted blocks and values of whole groups -> calibrated values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, values = None, [], []

        def out() -> pa.RecordBatch:
            enough = blocks and sum(b[4] for b in blocks) >= min_rows
            y = interpolate(blocks, values) if enough else [None] * len(values)
            return pa.RecordBatch.from_arrays([pa.array([group] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(y, pa.float64())], names=["g", "v", "y"])

        for batch in batches:
            for g, low, high, w, wy, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if values:
                        yield out()
                    group, blocks, values = g, [], []
                if w is None:
                    values.append(low)
                else:
                    pool(blocks, [low, high, w, wy, n])
        if values:
            yield out()

    return run


def _group(keys: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*keys)) if keys else F.lit(json.dumps({}))


def isotonic_blocks(fitted: DataFrame, keys: tuple[str, ...] = (), *, weight: str | None = None) -> DataFrame:
    """Blocks of each range of each group: ``g, low, high, w, wy, n`` (grid values, summed weights, weighted truths, rows)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = fitted.select(_group(keys).alias("g"), grid(F.col("y_pred")).alias("low"), F.col("y_true").cast("double").alias("y"), w.alias("w")).where("low is not null and y is not null and w > 0")
    points = rows.groupBy("g", "low").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n"))
    ranges = points.select("g", "low", F.col("low").alias("high"), "w", "wy", "n").repartitionByRange("g", "low").sortWithinPartitions("g", "low")
    return ranges.mapInArrow(_pool_ranges, _BLOCKS)


def calibrate(fitted: DataFrame, scored: DataFrame, keys: tuple[str, ...] = (), *, weight: str | None = None, min_rows: int = 30, out: str = "y_cal") -> DataFrame:
    """``scored`` with column ``out``: its ``y_pred`` through the map of its group, fitted on ``fitted`` (``y_pred, y_true``, group ``keys``)."""
    keyed = scored.withColumns({"_g": _group(keys), "_v": grid(F.col("y_pred"))})
    values = keyed.where("_v is not null").select(F.col("_g").alias("g"), F.col("_v").alias("low")).distinct()
    none = {"high": F.lit(None).cast("long"), "w": F.lit(None).cast("double"), "wy": F.lit(None).cast("double"), "n": F.lit(None).cast("long")}
    both = isotonic_blocks(fitted, keys, weight=weight).unionByName(values.withColumns(none))
    # all of a group, at most twice 10^DIGITS + 1 rows
    maps = both.repartition("g").sortWithinPartitions("g", "low").mapInArrow(_maps(min_rows), "g string, v long, y double")
    joined = keyed.join(maps.withColumnsRenamed({"g": "_g", "v": "_v", "y": "_y"}), ["_g", "_v"], "left")
    return joined.withColumn(out, F.coalesce("_y", "y_pred")).drop("_g", "_v", "_y").select(*scored.columns, out)
