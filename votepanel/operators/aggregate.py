"""Grouped aggregations: event aggregate, national reference, town/station statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votepanel.constants import EVENT_COLS, INDEX_COLS


def nz(c: Column | str) -> Column:
    """``x`` with 0 turned into null (safe denominator; Spark 4 ANSI division by zero raises)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != 0, c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return a / nz(b)


def _vote_sum(df: DataFrame, name: str = "voix_cat") -> Column:
    if "voix_sixths" in df.columns:
        return F.coalesce(F.sum("voix_sixths"), F.lit(0.0)) / F.lit(6.0)
    return F.coalesce(F.sum(name), F.lit(0.0))


def aggregate_event(expanded: DataFrame) -> DataFrame:
    """Station x election x category: summed votes, max of totals, share and rates (zero -> null).

    Rows with a null key are dropped first (group-by semantics of the original).
    """
    keys = [*INDEX_COLS, "category"]
    df = expanded.where(F.col(keys[0]).isNotNull())
    for k in keys[1:]:
        df = df.where(F.col(k).isNotNull())
    aggs = [
        _vote_sum(df).alias("voix_cat"),
        F.max("exprimes").alias("exprimes"),
        F.max("votants").alias("votants"),
        F.max("inscrits").alias("inscrits"),
        F.max("blancs").alias("blancs"),
        F.max("nuls").alias("nuls"),
    ]
    if "voix_sixths" in df.columns:
        aggs.append(F.coalesce(F.sum("voix_sixths"), F.lit(0.0)).alias("voix_sixths"))
    agg = df.groupBy(*keys).agg(*aggs)
    return agg.select(
        "*",
        safe_div("voix_cat", "exprimes").alias("share"),
        safe_div("votants", "inscrits").alias("turnout_pct"),
        safe_div("blancs", "inscrits").alias("blancs_pct"),
        safe_div("nuls", "inscrits").alias("nuls_pct"),
    )


def national_reference(local: DataFrame, keys: tuple[str, ...] = (*EVENT_COLS, "category")) -> DataFrame:
    """Reference share and turnout per election and category = sums over the rows supplied (Q17, Q18).

    Tiny output (events x 7): partial aggregation keeps the shuffle small even for hot events.
    """
    votes = (F.sum("voix_sixths") / F.lit(6.0)) if "voix_sixths" in local.columns else F.sum("voix_cat")
    nat = local.groupBy(*keys).agg(
        votes.alias("voix_cat"),
        F.sum("exprimes").alias("exprimes"),
        F.sum("votants").alias("votants"),
        F.sum("inscrits").alias("inscrits"),
    )
    return nat.select(
        *keys,
        safe_div("voix_cat", "exprimes").alias("share_nat"),
        safe_div("votants", "inscrits").alias("turnout_nat"),
    )


def turnout_event(local: DataFrame) -> DataFrame:
    """Max turnout per station-event."""
    return local.groupBy(*INDEX_COLS).agg(F.max("turnout_pct").alias("turnout_pct"))
