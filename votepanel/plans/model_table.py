"""Model table (station x bloc x election rows with calendar, lag, rolling, town and interaction features).

Every window is keyed by ``code_bv`` + ``bloc``; the input is hash-partitioned once on ``code_bv``.
The town feature is an aggregate per town-bloc-date joined back (broadcast only when its checked size
is small; otherwise a shuffle join on a key that includes bloc and date, so a big town is spread).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.functions.categories import normalise_bloc
from votepanel.operators.aggregate import nz
from votepanel.session import cut_lineage

# Lag steps and rolling window sizes of the model features.
LAG_STEPS = (1, 2, 3, 4, 7, 14, 28)
ROLL_WINDOWS = (3, 5, 7)

ORDER = ("date_scrutin", "type_scrutin", "tour")


def base_table_rules(df: DataFrame) -> DataFrame:
    """Lenient bloc, type lower-cased (null -> ``inconnu``), round null -> 1, year flag 2020, keep
    first rounds (and European votes, single-round)."""
    out = df.withColumn("bloc", normalise_bloc("bloc")).withColumn(
        "type_scrutin", F.lower(F.coalesce(F.col("type_scrutin").cast("string"), F.lit("inconnu")))
    )
    out = out.withColumn("tour", F.coalesce(F.expr("try_cast(tour as int)"), F.lit(1)))
    out = out.withColumn("is_2020", (F.col("annee") == 2020).cast("int"))
    return out.where((F.col("tour") == 1) | (F.col("type_scrutin") == "europeennes"))


def calendar_features(df: DataFrame) -> DataFrame:
    """Month and weekday (Monday = 0) with sine/cosine encodings."""
    two_pi = 2 * math.pi
    out = df.withColumn("month", F.month("date_scrutin")).withColumn("dow", F.weekday("date_scrutin"))
    return out.select(
        "*",
        F.sin(F.lit(two_pi) * F.col("month") / 12).alias("month_sin"),
        F.cos(F.lit(two_pi) * F.col("month") / 12).alias("month_cos"),
        F.sin(F.lit(two_pi) * F.col("dow") / 7).alias("dow_sin"),
        F.cos(F.lit(two_pi) * F.col("dow") / 7).alias("dow_cos"),
    )


def lag_rolling_features(df: DataFrame) -> DataFrame:
    """Lags 1..28 of part / turnout / gap and prior-row rolling mean, std, max (one window spec)."""
    w = Window.partitionBy("code_bv", "bloc").orderBy(*ORDER)
    cols = []
    for k in LAG_STEPS:
        cols.append(F.lag("part_bloc", k).over(w).alias(f"part_bloc_lag{k}"))
        cols.append(F.lag("taux_participation_bv", k).over(w).alias(f"taux_participation_bv_lag{k}"))
        cols.append(F.lag("ecart_bloc_vs_national", k).over(w).alias(f"ecart_bloc_vs_national_lag{k}"))
    for n in ROLL_WINDOWS:
        fr = w.rowsBetween(-n, -1)
        cols += [
            F.avg("part_bloc").over(fr).alias(f"part_bloc_roll_mean_{n}"),
            F.stddev_samp("part_bloc").over(fr).alias(f"part_bloc_roll_std_{n}"),
            F.max("part_bloc").over(fr).alias(f"part_bloc_roll_max_{n}"),
            F.avg("taux_participation_bv").over(fr).alias(f"taux_participation_roll_mean_{n}"),
        ]
    # lags of the input table (computed over all rounds) are replaced by lags over the kept rows
    stale = [c for c in df.columns if c.startswith(("part_bloc_lag", "taux_participation_bv_lag", "ecart_bloc_vs_national_lag"))]
    return df.drop(*stale).select("*", *cols)


def station_trend(df: DataFrame, y: str = "part_bloc") -> DataFrame:
    """y lag 1, lag 2, mean of the 3 previous values, trend lag1 - lag2."""
    w = Window.partitionBy("code_bv", "bloc").orderBy(*ORDER)
    return df.select(
        "*",
        F.lag(y, 1).over(w).alias("y_lag1_bv"),
        F.lag(y, 2).over(w).alias("y_lag2_bv"),
        F.avg(y).over(w.rowsBetween(-3, -1)).alias("y_rollmean_3_bv"),
    ).withColumn("y_trend_bv", F.col("y_lag1_bv") - F.col("y_lag2_bv"))


def town_weighted_avg(df: DataFrame, y: str = "part_bloc") -> DataFrame:
    """Town share per bloc and date weighted by valid votes (null weight -> 1, floor 1); null when any
    value of the group is null (Q30)."""
    wgt = F.greatest(F.coalesce(F.col("exprimes"), F.lit(1.0)), F.lit(1.0))
    g = df.groupBy("code_commune", "bloc", "date_scrutin").agg(
        F.sum(F.col(y) * wgt).alias("_num"), F.sum(F.when(F.col(y).isNotNull(), wgt)).alias("_den"),
        F.count(y).alias("_n"), F.count(F.lit(1)).alias("_all"),
    )
    return g.select(
        "code_commune", "bloc", "date_scrutin",
        F.when((F.col("_n") > 0) & (F.col("_n") == F.col("_all")), F.col("_num") / F.col("_den")).alias("y_comm"),
    )


def town_lag(df: DataFrame, y: str = "part_bloc") -> DataFrame:
    """Previous town share of the bloc, joined back on town, bloc, date."""
    town = town_weighted_avg(df, y)
    w = Window.partitionBy("code_commune", "bloc").orderBy("date_scrutin")
    town = town.select("code_commune", "bloc", "date_scrutin", F.lag("y_comm", 1).over(w).alias("y_comm_lag1"))
    return df.join((town), on=["code_commune", "bloc", "date_scrutin"], how="left")


def interaction_features(df: DataFrame) -> DataFrame:
    ins = nz("inscrits")
    return df.select(
        "*",
        (F.col("voix_bloc") / ins).alias("voix_bloc_sur_inscrits"),
        (F.col("exprimes") / ins).alias("exprimes_sur_inscrits"),
        (F.col("votants") / ins).alias("votants_sur_inscrits"),
        (F.col("part_bloc_lag1") * F.col("taux_participation_bv")).alias("part_bloc_lag1_x_participation"),
        (F.col("part_bloc_lag1") * F.col("ecart_bloc_vs_national")).alias("part_bloc_lag1_x_ecart_nat"),
        (F.col("taux_participation_bv") * F.col("ecart_bloc_vs_national")).alias("participation_x_ecart_nat"),
        (F.col("part_bloc_lag1") - F.col("part_bloc_lag2")).alias("part_bloc_trend_1"),
        (F.col("part_bloc_lag1") - F.col("part_bloc_lag4")).alias("part_bloc_trend_2"),
    )


def model_table(blocs: DataFrame, *, drop_na_target: bool = True) -> DataFrame:
    """elections_blocs -> model table (calendar + lags + station trend + town lag + interactions)."""
    base = base_table_rules(blocs).repartition("code_bv")
    out = interaction_features(town_lag(station_trend(lag_rolling_features(calendar_features(base)))))
    return out.where(F.col("part_bloc").isNotNull()) if drop_na_target else out


def target_rows(blocs: DataFrame, target_type: str, target_year: int, *, month: int = 3, day: int = 15) -> DataFrame:
    """Features of an election to forecast: the last row of every station x bloc that the base rules keep is moved to the target date and
    type, with an unknown share and the target year centred on the median year of the base rows; features are then computed
    over base rows and moved rows together, and the moved rows returned. Measures of a moved row are those of its last election."""
    from votepanel.plans.blocs import column_median

    base = cut_lineage(base_table_rules(blocs), "base_rows")  # read by the median, the last rows and the union
    median = column_median(base, "annee")
    w = Window.partitionBy("code_bv", "bloc").orderBy(*[F.col(c).desc() for c in ORDER])
    last = base.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    moved = last.withColumns({
        "annee": F.lit(target_year).cast(base.schema["annee"].dataType), "date_scrutin": F.make_date(F.lit(target_year), F.lit(month), F.lit(day)).cast(base.schema["date_scrutin"].dataType),
        "type_scrutin": F.lit(target_type), "tour": F.lit(1), "annee_centre": (F.lit(target_year) - F.lit(median)).cast("double"), "part_bloc": F.lit(None).cast("double"), "is_target": F.lit(True),
    })
    both = base.withColumn("is_target", F.lit(False)).unionByName(moved)
    return model_table(both, drop_na_target=False).where("is_target").drop("is_target")
