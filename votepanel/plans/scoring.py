"""Scoring features for a future election, as-of lookups, and the prediction report.

The original loops over stations; here every station is scored at once. One exchange on ``code_bv``
serves the as-of window and the per-station aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES

ORDER = ("date_scrutin", "election_type", "round")


def _ord():
    return F.struct(*[F.col(c) for c in ORDER])


def filter_history(df: DataFrame, target_year: int, commune_code: str | None = None, *, year_col: str = "election_year", town_col: str = "commune_code") -> DataFrame:
    """Rows strictly before the target year, optionally one town (both pushed to the scan)."""
    out = df.where(F.col(year_col) < target_year)
    if commune_code is not None:
        out = out.where(F.col(town_col) == commune_code)
    return out


def last_non_null(value: str, keep=None):
    """Value of the latest row (time order) where ``value`` is not null (and ``keep`` holds)."""
    cond = F.col(value).isNotNull() if keep is None else (F.col(value).isNotNull() & keep)
    return F.max_by(F.col(value), F.when(cond, _ord()))


def asof_last_event(local: DataFrame, target_type: str) -> DataFrame:
    """Per station x category: last known share / deviation before the target, any type and same type."""
    d = local.withColumn("dev_to_nat", F.col("share") - F.col("share_nat"))
    is_t = F.col("election_type") == target_type
    return d.groupBy("code_bv", "category").agg(
        last_non_null("share").alias("last_share_any"),
        last_non_null("dev_to_nat").alias("last_dev_any"),
        last_non_null("share", is_t).alias("last_share_type"),
        last_non_null("dev_to_nat", is_t).alias("last_dev_type"),
    )


def swing_last_two(local: DataFrame) -> DataFrame:
    """Share of the last row minus share of the second-last row (nulls kept, Q16)."""
    w = Window.partitionBy("code_bv", "category").orderBy(*[F.col(c).desc() for c in ORDER])
    r = local.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    return r.groupBy("code_bv", "category").agg(
        (F.max(F.when(F.col("_rn") == 1, F.col("share"))) - F.max(F.when(F.col("_rn") == 2, F.col("share")))).alias("swing_any")
    )


def score_features(local: DataFrame, target_type: str, target_year: int) -> DataFrame:
    """One row per station for a future (type, year): last shares / deviations (any, same type), swing
    of the last two elections, last turnout (any, same type). ``local`` is the event-category table with
    ``share_nat`` of the history (rows before ``target_year``)."""
    d = local.where(F.col("election_year") < target_year).repartition("code_bv")
    d = d.withColumn("dev_to_nat", F.col("share") - F.col("share_nat"))
    w = Window.partitionBy("code_bv", "category").orderBy(*[F.col(c).desc() for c in ORDER])
    d = d.withColumn("_rn", F.row_number().over(w))
    is_t = F.col("election_type") == target_type
    aggs = [
        last_non_null("turnout_pct").alias("prev_turnout_any_lag1"),
        last_non_null("turnout_pct", is_t).alias("prev_turnout_same_type_lag1"),
    ]
    for c in CATEGORIES:
        in_c = F.col("category") == c
        aggs += [
            last_non_null("share", in_c).alias(f"prev_share_any_lag1_{c}"),
            last_non_null("share", in_c & is_t).alias(f"prev_share_type_lag1_{c}"),
            last_non_null("dev_to_nat", in_c).alias(f"prev_dev_to_national_any_lag1_{c}"),
            last_non_null("dev_to_nat", in_c & is_t).alias(f"prev_dev_to_national_type_lag1_{c}"),
            (F.max(F.when(in_c & (F.col("_rn") == 1), F.col("share"))) - F.max(F.when(in_c & (F.col("_rn") == 2), F.col("share")))).alias(f"swing_any_{c}"),
        ]
    g = d.groupBy("code_bv").agg(*aggs)
    return g.select(
        F.substring_index("code_bv", "-", 1).alias("commune_code"),
        "code_bv",
        F.lit(target_type).alias("election_type"),
        F.lit(target_year).alias("election_year"),
        F.lit(1).alias("round"),
        F.make_date(F.lit(target_year), F.lit(1), F.lit(1)).alias("date_scrutin"),
        *[c for c in g.columns if c != "code_bv"],
    )


def latest_rows(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Last row per key (``row_number`` over descending time = 1)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def join_last_refs(preds: DataFrame, local: DataFrame, *, leg_type: str, mun_type: str, mun_year: int, target_year: int) -> DataFrame:
    """Attach the last share of a reference type before the target year and the share of one past
    election (the two delta references of the report)."""
    leg = local.where((F.col("election_type") == leg_type) & (F.col("election_year") < target_year)).groupBy("code_bv", "category").agg(
        F.max_by("share", F.when(F.col("share").isNotNull(), _ord())).alias("ref_leg")
    )
    mun = local.where((F.col("election_type") == mun_type) & (F.col("election_year") == mun_year)).groupBy("code_bv", "category").agg(
        F.max_by("share", F.when(F.col("share").isNotNull(), _ord())).alias("ref_mun")
    )
    return preds.join(leg, on=["code_bv", "category"], how="left").join(mun, on=["code_bv", "category"], how="left")


def predict_output(preds_long: DataFrame, *, decimals: int | None = 2) -> DataFrame:
    """Shares in percent rounded to ``decimals`` (half-even; None = unrounded) and deltas to the two
    references (null when no reference), one wide row per station."""
    pct = F.col("predicted_share") * 100

    def rnd(c):
        return c if decimals is None else F.bround(c, decimals)

    d = preds_long.select(
        "commune_code",
        "code_bv",
        "category",
        rnd(pct).alias("p"),
        rnd(pct - F.col("ref_leg") * 100).alias("dl"),
        rnd(pct - F.col("ref_mun") * 100).alias("dm"),
    )
    aggs = []
    for c in CATEGORIES:
        in_c = F.col("category") == c
        aggs += [
            F.max(F.when(in_c, F.col("p"))).alias(f"predicted_share_{c}"),
            F.max(F.when(in_c, F.col("dl"))).alias(f"delta_leg_{c}"),
            F.max(F.when(in_c, F.col("dm"))).alias(f"delta_mun2020_{c}"),
        ]
    return d.groupBy("commune_code", "code_bv").agg(*aggs)


def winner(df: DataFrame, keys: tuple[str, ...], cat_col: str = "category", share_col: str = "share") -> DataFrame:
    """Category with the highest share per key; ties -> first in model-output order."""
    idx = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col(cat_col))
    return df.groupBy(*keys).agg(
        F.max_by(F.col(cat_col), F.struct(F.col(share_col), (-idx).alias("i"))).alias("winner"),
        F.max(share_col).alias("winner_share"),
    )
