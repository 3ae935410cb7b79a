"""Evaluation metrics and diagnostics over a long prediction table.

Input shape (``diag``): one row per station x election x category with ``y_true`` and ``y_pred``
(optionally ``weight``). Means are one aggregation pass; medians and tail quantiles are exact (linear
interpolation, same as the original's quantiles) through the bracketed two-pass operator of
``votepanel.operators.quantiles`` (no group is ever merged whole in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES
from votepanel.operators.quantiles import exact_quantiles

EVENT_KEYS = ("code_bv", "election_type", "election_year", "round")


def ordered_sum(col: str, w) -> F.Column:
    """Sum over a small window (the categories of one station-election) in ascending value order, so
    the result does not depend on row order or partitioning (bounded by the 7 categories)."""
    return F.aggregate(F.array_sort(F.collect_list(col).over(w)), F.lit(0.0), lambda a, x: a + x)


def normalise_predictions(diag: DataFrame, *, keys: tuple[str, ...] = EVENT_KEYS, pred: str = "y_pred") -> DataFrame:
    """Clip predictions to [0, 1] and divide by their sum per station-election (sum 0 -> 1)."""
    clipped = F.least(F.greatest(F.col(pred), F.lit(0.0)), F.lit(1.0))
    d = diag.withColumn(pred, clipped)
    s = ordered_sum(pred, Window.partitionBy(*keys))
    return d.withColumn(pred, F.col(pred) / F.when(s == 0, F.lit(1.0)).otherwise(s))


def normalise_in_station(diag: DataFrame, *, pred: str = "y_pred", out: str = "p_norm", keys: tuple[str, ...] = ("code_bv",)) -> DataFrame:
    """Clip, then divide by the station sum with a floor of 1e-9."""
    c = F.least(F.greatest(F.col(pred), F.lit(0.0)), F.lit(1.0))
    d = diag.withColumn(pred, c)
    s = ordered_sum(pred, Window.partitionBy(*keys))
    return d.withColumn(out, F.col(pred) / F.greatest(s, F.lit(1e-9)))


def _cat_index():
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))


def winners(diag: DataFrame, *, keys: tuple[str, ...] = EVENT_KEYS) -> DataFrame:
    """True and predicted winner per station-election (ties -> first category in model order)."""
    idx = _cat_index()
    return diag.groupBy(*keys).agg(
        F.max_by("category", F.struct(F.col("y_true"), (-idx).alias("i"))).alias("winner_true"),
        F.max_by("category", F.struct(F.col("y_pred"), (-idx).alias("i"))).alias("winner_pred"),
    )


def winner_accuracy(diag: DataFrame, *, keys: tuple[str, ...] = EVENT_KEYS) -> DataFrame:
    w = winners(diag, keys=keys)
    return w.agg(F.avg((F.col("winner_true") == F.col("winner_pred")).cast("double")).alias("winner_accuracy"), F.count(F.lit(1)).alias("n_events"))


def regression_metrics(diag: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, median AE, R2, explained variance, WAPE, SMAPE, bias and MAE per category: one row, or one for each group ``by``
    (columns without nulls)."""
    err = F.col("y_pred") - F.col("y_true")
    ae = F.abs(err)
    per_cat = [F.avg(F.when(F.col("category") == c, ae)).alias(f"mae_{c}") for c in CATEGORIES]
    m = diag.groupBy(*by).agg(
        F.avg(ae).alias("mae_mean"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_ssr"),
        F.var_pop("y_true").alias("_vy"),
        F.count(F.lit(1)).alias("_n"),
        F.var_pop(F.col("y_true") - F.col("y_pred")).alias("_vres"),
        F.sum(ae).alias("_sae"),
        F.sum(F.abs("y_true")).alias("_sy"),
        F.avg(2 * ae / (F.abs("y_true") + F.abs("y_pred") + F.lit(1e-9))).alias("smape"),
        F.avg(err).alias("bias"),
        *per_cat,
    )
    n = F.col("_n")
    med = exact_quantiles(diag, ae, {"medae": 0.5}, tuple(by))
    m = m.join(med, list(by)) if by else _attach_scalar_row(m, med)
    return m.select(
        *by,
        "mae_mean",
        "rmse",
        "medae",
        F.when(n > 1, 1 - F.col("_ssr") / (F.col("_vy") * n)).alias("r2"),
        F.when(n > 1, 1 - F.col("_vres") / F.col("_vy")).alias("explained_var"),
        F.when(F.col("_sy") > 0, F.col("_sae") / F.col("_sy")).alias("wape"),
        "smape",
        "bias",
        *[f"mae_{c}" for c in CATEGORIES],
    )


def weighted_mae(diag: DataFrame, weight: str = "weight") -> DataFrame:
    """Weighted MAE over rows where truth and prediction exist (null when the weight sum <= 0)."""
    ok = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    num = F.sum(F.when(ok, F.abs(F.col("y_true") - F.col("y_pred")) * F.col(weight)))
    den = F.sum(F.when(ok, F.col(weight)))
    return diag.agg(F.when(den > 0, num / den).alias("weighted_mae"))


def error_by_group(diag: DataFrame) -> DataFrame:
    """MAE by bloc, by year and by type in one pass (grouping sets), long: dimension, key, mae, n."""
    ae = F.abs(F.col("y_pred") - F.col("y_true"))
    d = diag.select(F.col("category"), F.col("election_year").cast("string").alias("year"), F.col("election_type"), ae.alias("ae"))
    g = d.groupingSets([["category"], ["year"], ["election_type"]], "category", "year", "election_type").agg(
        F.avg("ae").alias("mae"), F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("_gid"),
    )
    dim = F.when(F.col("category").isNotNull(), F.lit("bloc")).when(F.col("year").isNotNull(), F.lit("year")).otherwise(F.lit("election_type"))
    return g.select(dim.alias("dimension"), F.coalesce("category", "year", "election_type").alias("key"), "mae", "n")


# Right-closed bins of the true share and their labels.
BIN_EDGES = (-0.001, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 1.0)
BIN_LABELS = ("<=0.05", "0.05-0.10", "0.10-0.15", "0.15-0.20", "0.20-0.25", "0.25-0.30", ">0.30")


def bin_label(c: str = "y_true"):
    """Right-closed bin label (``Bucketizer`` is left-closed, hence the explicit chain)."""
    expr = None
    for lo, hi, lab in zip(BIN_EDGES[:-1], BIN_EDGES[1:], BIN_LABELS):
        cond = (F.col(c) > lo) & (F.col(c) <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def error_by_bin(diag: DataFrame) -> DataFrame:
    ae = F.abs(F.col("y_pred") - F.col("y_true"))
    d = diag.select(bin_label().alias("bin_part"), ae.alias("abs_error")).where(F.col("bin_part").isNotNull())
    base = d.groupBy("bin_part").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"))
    q = exact_quantiles(d, "abs_error", {"medae": 0.5, "p95": 0.95, "p99": 0.99}, ("bin_part",))
    return base.join(q, on="bin_part", how="left")


def error_in_zone(diag: DataFrame, lo: float = 0.12, hi: float = 0.15) -> DataFrame:
    ae = F.abs(F.col("y_pred") - F.col("y_true"))
    z = diag.where((F.col("y_true") >= lo) & (F.col("y_true") <= hi)).withColumn("_ae", ae)
    m = z.agg(F.count(F.lit(1)).alias("n"), F.avg("_ae").alias("mae"), F.avg(F.col("y_pred") - F.col("y_true")).alias("bias"))
    q = exact_quantiles(z, "_ae", {"medae": 0.5, "p95": 0.95, "p99": 0.99})
    return _attach_scalar_row(m, q).select("n", "mae", "medae", "bias", "p95", "p99")


def residual_quantiles(diag: DataFrame, qs: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    r = F.col("y_pred") - F.col("y_true")
    return exact_quantiles(diag, r, {f"q{int(round(q * 100)):02d}": q for q in qs})


def residual_intervals(diag: DataFrame, qs: tuple[float, ...] = (0.05, 0.1, 0.9, 0.95)) -> DataFrame:
    """Per category: residual (pred - true) quantiles, mean, population std and count."""
    r = F.col("y_pred") - F.col("y_true")
    d = diag.withColumn("_r", r)
    m = d.groupBy("category").agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"), F.count("_r").alias("n"))
    q = exact_quantiles(d, "_r", {f"q{int(round(x * 100)):02d}": x for x in qs}, ("category",))
    return q.join(m, on="category", how="inner").select("category", *[f"q{int(round(x * 100)):02d}" for x in qs], "mean", "std", "n")


def _attach_scalar_row(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to a one-row aggregate (join on a constant key)."""
    return left.withColumn("_k", F.lit(1)).join(F.broadcast(one_row.withColumn("_k", F.lit(1))), on="_k").drop("_k")
