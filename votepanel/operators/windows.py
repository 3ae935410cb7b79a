"""Window operators over station time series.

All station windows are partitioned by ``code_bv`` first; hash-partitioning the input once by
``code_bv`` satisfies every spec here, so a chain of them costs a single exchange. A station holds at
most (#elections x 7) rows, so no window partition grows with the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Deterministic time order inside a station (Q14): date, then type, then round.
TIME_ORDER = ("date_scrutin", "election_type", "round")


def station_window(*keys: str, order: tuple[str, ...] = TIME_ORDER):
    return Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])


def panel_lags(local: DataFrame, *, strict_before: bool = False) -> DataFrame:
    """Lag 1/2 of share (any type), lag 1 same type, deviation to the reference and its lags, swing.

    ``local`` needs ``share`` and ``share_nat``. ``strict_before=True`` makes lags use only events of
    strictly earlier dates (same-date events of other types are not visible).
    """
    w_any = station_window("code_bv", "category")
    w_type = station_window("code_bv", "category", "election_type")
    df = local.withColumn("dev_to_nat", F.col("share") - F.col("share_nat"))
    if not strict_before:
        lag1 = F.lag("share", 1).over(w_any)
        lag2 = F.lag("share", 2).over(w_any)
        cols = [
            lag1.alias("share_lag_any"),
            lag2.alias("share_lag2_any"),
            F.lag("share", 1).over(w_type).alias("share_lag_same_type"),
            F.lag("dev_to_nat", 1).over(w_any).alias("dev_to_nat_lag_any"),
            F.lag("dev_to_nat", 1).over(w_type).alias("dev_to_nat_lag_same_type"),
        ]
        df = df.select("*", *cols)
    else:
        # Only events of strictly earlier dates are visible. A range frame on the day number ending at
        # -1 collects them (bounded by the number of elections of one station), sorted in time order.
        days = F.datediff(F.col("date_scrutin"), F.lit("1900-01-01").cast("date"))
        df = df.withColumn("_d", days)
        item = F.struct(F.col("_d"), F.col("election_type"), F.col("round"), F.col("share").alias("s"), F.col("dev_to_nat").alias("v"))
        wa = Window.partitionBy("code_bv", "category").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
        wt = Window.partitionBy("code_bv", "category", "election_type").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_pa", F.sort_array(F.collect_list(item).over(wa))).withColumn(
            "_pt", F.sort_array(F.collect_list(item).over(wt))
        )
        df = df.select(
            "*",
            F.try_element_at("_pa", F.lit(-1)).getField("s").alias("share_lag_any"),
            F.try_element_at("_pa", F.lit(-2)).getField("s").alias("share_lag2_any"),
            F.try_element_at("_pt", F.lit(-1)).getField("s").alias("share_lag_same_type"),
            F.try_element_at("_pa", F.lit(-1)).getField("v").alias("dev_to_nat_lag_any"),
            F.try_element_at("_pt", F.lit(-1)).getField("v").alias("dev_to_nat_lag_same_type"),
        ).drop("_d", "_pa", "_pt")
    return df.withColumn("swing_any", F.col("share_lag_any") - F.col("share_lag2_any"))


def turnout_lags(events: DataFrame, col: str = "turnout_pct") -> DataFrame:
    """Previous turnout of the station (any type / same type)."""
    return events.select(
        "*",
        F.lag(col, 1).over(station_window("code_bv")).alias("prev_turnout_any_lag1"),
        F.lag(col, 1).over(station_window("code_bv", "election_type")).alias("prev_turnout_same_type_lag1"),
    )


def multi_lags(df: DataFrame, cols: list[str], lags: tuple[int, ...], keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Several lags of several measures in one projection (one window spec, one sort)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in lags])


def rolling_prior(df: DataFrame, col: str, sizes: tuple[int, ...], keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Mean / sample std / max over the previous ``w`` rows (current row excluded, min 1 row)."""
    base = Window.partitionBy(*keys).orderBy(*order)
    out = []
    for w in sizes:
        fr = base.rowsBetween(-w, -1)
        out += [
            F.avg(col).over(fr).alias(f"{col}_roll_mean_{w}"),
            F.stddev_samp(col).over(fr).alias(f"{col}_roll_std_{w}"),
            F.max(col).over(fr).alias(f"{col}_roll_max_{w}"),
        ]
    return df.select("*", *out)


def last_non_null(col: str, w) -> Column:
    return F.last(col, ignorenulls=True).over(w)
