"""Ridge models of every training set, target and penalty from one scan: sums of products per election.

Linear least squares needs a training set only through sums of products of its columns, and those of a training set are the sums over
its elections. :func:`event_statistics` makes them once per election, over the columns ``1, features (missing as 0), missing flags,
targets``. The flags let a feature be filled afterwards with any value: ``x + fill * missing`` is linear in the columns, so the products
of the filled features follow from the stored ones. Medians to fill with differ per training set too; they come from counts per election on a
grid of 1 / GRID, made in the same scan. So expanding folds, left-out years, learning curves, penalties and all targets cost small
matrix solves and no further pass over the rows.

What grows with the data is one pass with partial sums (a task holds one matrix per election and adds its batches to it) and an
aggregation by cell. The driver gets cells per election: elections x (1 + 2 features + targets)^2 / 2 numbers, whatever the
number of stations.

The steps are those of the Spark ML pipeline in ``operators.ml``: median fill, features with a sample variance of 1e-6 or less
dropped, standardised; the penalty ``alpha`` is added to the sums of products of the standardised features.

Defined results: rows without a target, or (weighted) without a positive weight, train nothing; a feature without any value in a training set is filled with 0, and dropped there as constant; a
training set without rows gives no model; a training set of one row predicts its targets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import TARGET_COLS
from votepanel.session import cut_lineage

GRID = 4096
MIN_VARIANCE = 1e-6
#: Cells (numbers) a task holds before it hands its sums on.
HELD_CELLS = 2_000_000
STATISTICS = "event_key string, feature int, cell long, value double"


def event_key(key_cols: Sequence[str] = ("election_type", "election_year", "round")) -> Column:
    return F.concat_ws("|", F.lower(F.trim(F.col(key_cols[0]))), *[F.col(c).cast("string") for c in key_cols[1:]])


def _sums(n_features: int, n_targets: int):
    """Sums of a task: batches add to one matrix an election and one count a grid cell; both leave at the end, or when the cells (or the
    elections) held reach a limit, so a task's memory is bounded whatever its rows."""
    size = 1 + 2 * n_features + n_targets
    upper = np.triu_indices(size)

    def merged(counts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Rows by series and cell of several tables of them."""
        series, cells, rows = (np.concatenate(c) for c in zip(*counts, strict=True))
        if not len(series):
            return series, cells, rows
        order = np.lexsort((cells, series))
        series, cells = series[order], cells[order]
        first = np.flatnonzero(np.concatenate([[True], (series[1:] != series[:-1]) | (cells[1:] != cells[:-1])]))
        return series[first], cells[first], np.add.reduceat(rows[order], first)

    def flushed(products: dict[str, np.ndarray], counts: list[tuple[np.ndarray, ...]], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        series, cells, held = merged(counts)
        names = list(numbers)
        event, feature, cell, value = [series // max(n_features, 1)], [series % max(n_features, 1)], [cells], [held]
        for key, g in products.items():
            event.append(np.full(len(upper[0]), numbers[key]))
            feature.append(np.full(len(upper[0]), -1))
            cell.append(np.arange(len(upper[0])))
            value.append(g[upper])
        event, feature, cell, value = (np.concatenate(c) for c in (event, feature, cell, value))
        keys = pa.DictionaryArray.from_arrays(pa.array(event.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        out = pa.RecordBatch.from_arrays([keys, pa.array(feature.astype(np.int32)), pa.array(cell.astype(np.int64)), pa.array(value)], names=["event_key", "feature", "cell", "value"])
        yield from (out.slice(k, 50_000) for k in range(0, out.num_rows, 50_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[str, np.ndarray] = {}
        numbers: dict[str, int] = {}
        counts: list[tuple[np.ndarray, ...]] = []  # election * features + feature, grid cell, rows
        for batch in batches:
            if not batch.num_rows:
                continue
            events = batch.column(0).dictionary_encode()
            event = events.indices.to_numpy(zero_copy_only=False)
            names = events.dictionary.to_pylist()
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            weight, x, y = values[:, 0], values[:, 1 : 1 + n_features], values[:, 1 + n_features :]
            missing = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), np.where(missing, 0.0, x), missing, y])
            number = np.array([numbers.setdefault(name, len(numbers)) for name in names], np.int64)
            row, j = np.nonzero(~missing)
            cell = np.floor(x[row, j] * GRID).astype(np.int64)
            counts.append(merged([(number[event[row]] * n_features + j, cell, np.ones(len(cell)))]))
            order = np.argsort(event, kind="stable")
            for e, mine in zip(names, np.split(order, np.cumsum(np.bincount(event, minlength=len(names)))[:-1]), strict=True):
                g = z[mine].T @ (z[mine] * weight[mine, None])
                products[e] = products[e] + g if e in products else g
            if sum(len(k) for k, _, _ in counts) >= HELD_CELLS:
                counts = [merged(counts)]
            if len(counts[0][0]) >= HELD_CELLS // 2 or len(products) * size * size >= HELD_CELLS:
                yield from flushed(products, counts, numbers)
                products, numbers, counts = {}, {}, []
        if products:
            yield from flushed(products, counts, numbers)

    return run


def event_statistics(panel: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGET_COLS, *, weight: str | None = None) -> DataFrame:
    """Per election: cells of the matrix of sums of products (``feature`` -1, numbered along the upper triangle), and per feature the
    number of rows in each grid cell. Written once."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in targets])
    rows = panel.where(known).select(event_key().alias("event_key"), w.alias("_w"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate((*features, *targets))]).where("_w > 0")
    cells = rows.mapInArrow(_sums(len(features), len(targets)), STATISTICS)
    return cut_lineage(cells.groupBy("event_key", "feature", "cell").agg(F.sum("value").alias("value")), "event_statistics")


def fills(statistics: DataFrame, training: DataFrame) -> DataFrame:
    """``model, feature, fill``: the middle of the grid cell that holds the (lower) median of the feature in the training set."""
    counts = statistics.where("feature >= 0").join(F.broadcast(training), "event_key").groupBy("model", "feature", "cell").agg(F.sum("value").alias("n"))
    w = Window.partitionBy("model", "feature")
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    return upto.where(2 * F.col("upto") >= F.col("all")).groupBy("model", "feature").agg(((F.min("cell") + 0.5) / GRID).alias("fill"))


def standardised(products: np.ndarray, n_features: int, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the filled columns (features, then targets): means, centred sums of products, and the features' scales (0: constant)."""
    f = n_features
    t = len(products) - 1 - 2 * f
    filled = np.zeros((1 + f + t, len(products)))
    filled[0, 0] = 1
    filled[1 : 1 + f, 1 : 1 + f] = np.eye(f)
    filled[1 : 1 + f, 1 + f : 1 + 2 * f] = np.diag(fill)
    filled[1 + f :, 1 + 2 * f :] = np.eye(t)
    a = filled @ products @ filled.T
    n = a[0, 0]
    mean = a[0, 1:] / n
    centred = a[1:, 1:] - n * np.outer(mean, mean)
    variance = np.diag(centred)[:f] / max(n - 1, 1e-300)
    return mean, centred, np.where(variance > MIN_VARIANCE, np.sqrt(np.maximum(variance, 0)), 0.0)


def solve_ridge(products: np.ndarray, n_features: int, fill: np.ndarray, alphas: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per penalty: intercepts (targets) and coefficients (targets x features) from the sums of products of one training set."""
    f = n_features
    mean, centred, scale = standardised(products, f, fill)
    keep = scale > 0
    scale = np.where(keep, scale, 1.0)
    s = (centred[:f, :f] / np.outer(scale, scale))[np.ix_(keep, keep)]
    b = (centred[:f, f:] / scale[:, None])[keep]
    out = []
    for alpha in alphas:
        if not alpha >= 0:
            raise ValueError(f"a penalty is not negative: {alpha}")
        coef = np.zeros((len(mean) - f, f))
        if keep.any():
            coef[:, keep] = np.linalg.solve(s + alpha * np.eye(len(s)), b).T
        coef /= scale
        out.append((mean[f:] - coef @ mean[:f], coef))
    return out


class TrainingSums:
    """Sums of products and fills of every training set, on the driver: elections x cells are read, whatever the number of rows.

    ``training``: ``model`` and the ``event_key`` of each of its elections (a small table: elections x models)."""

    def __init__(self, statistics: DataFrame, training: DataFrame, n_features: int, n_targets: int) -> None:
        self.spark, self.n_features = statistics.sparkSession, n_features
        self.kind = training.schema["model"].dataType.simpleString()
        training = training.select("model", "event_key").distinct()
        size = 1 + 2 * n_features + n_targets
        upper = np.triu_indices(size)
        cells = statistics.where("feature = -1").select("event_key", "cell", "value").toArrow()
        keys = cells.column(0).combine_chunks().dictionary_encode()
        flat = np.zeros((len(keys.dictionary), len(upper[0])))
        flat[keys.indices.to_numpy(), cells.column(1).to_numpy()] = cells.column(2).to_numpy()
        row = {k: i for i, k in enumerate(keys.dictionary.to_pylist())}
        total: dict = {}
        for r in training.orderBy("model", "event_key").collect():
            if r.event_key in row:
                total[r.model] = total.get(r.model, 0) + flat[row[r.event_key]]
        self.products = {}
        for model, values in total.items():
            m = np.zeros((size, size))
            m[upper] = values
            self.products[model] = m + np.triu(m, 1).T
        self.fill = {m: np.zeros(n_features) for m in self.products}
        for r in fills(statistics, training).collect():
            self.fill[r.model][r.feature] = r.fill

    def scaling(self, model) -> tuple[list[float], list[float], list[float]]:
        """Fills, means and scales (0: dropped) of the features of a training set."""
        mean, _, scale = standardised(self.products[model], self.n_features, self.fill[model])
        return self.fill[model].tolist(), mean[: self.n_features].tolist(), scale.tolist()

    def models(self, alphas: Sequence[float]) -> DataFrame:
        """``model, alpha, n, fill, intercept, coef`` of every set and penalty."""
        out = []
        for model, products in self.products.items():
            for alpha, (intercept, coef) in zip(alphas, solve_ridge(products, self.n_features, self.fill[model], alphas), strict=True):
                out.append((model, float(alpha), float(products[0, 0]), self.fill[model].tolist(), intercept.tolist(), coef.tolist()))
        return self.spark.createDataFrame(out, f"model {self.kind}, alpha double, n double, fill array<double>, intercept array<double>, coef array<array<double>>")


def fit_ridge(statistics: DataFrame, training: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGET_COLS, alphas: Sequence[float] = (1.0,)) -> DataFrame:
    """Models of every training set and penalty: ``model, alpha, n, fill, intercept, coef``."""
    return TrainingSums(statistics, training, len(features), len(targets)).models(alphas)


def score_ridge(rows: DataFrame, models: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGET_COLS) -> DataFrame:
    """``rows`` (with a column ``model``) and ``pred_{category}`` of each target, once per penalty of the row's model (column ``alpha``)."""
    x = F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), "fill", lambda v, fill: F.coalesce(v, fill))
    scored = rows.join(F.broadcast(models), "model").withColumn("_x", x)

    def dot(t: int) -> Column:
        return F.aggregate(F.zip_with(F.get("coef", F.lit(t)), "_x", lambda c, v: c * v), F.get("intercept", F.lit(t)), lambda a, b: a + b)

    scored = scored.withColumns({f"pred_{c.replace('target_share_', '')}": dot(t) for t, c in enumerate(targets)})
    return scored.drop("_x", "fill", "intercept", "coef", "n")


def training_sets(folds: DataFrame, role: str = "train") -> DataFrame:
    """Fold tables (``event_key, fold, role``) as ``model, event_key``."""
    return folds.where(F.col("role") == role).select(F.col("fold").alias("model"), "event_key")


def rows_of(panel: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of every set (``model, event_key``) with the set's name in ``model``; the table of sets is elections x models."""
    return panel.withColumn("event_key", event_key()).join(F.broadcast(sets.select("model", "event_key")), "event_key")


def whole_set(panel: DataFrame, model: str, condition: Column) -> DataFrame:
    """``model, event_key`` of the elections with rows under a condition."""
    return panel.where(condition).select(F.lit(model).alias("model"), event_key().alias("event_key")).distinct()
