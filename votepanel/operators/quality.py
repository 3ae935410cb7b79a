"""Data-quality checks (warn-level in the original): each returns the offending rows or a count table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votepanel.constants import TARGET_COLS


def check_turnout_bound(events: DataFrame) -> DataFrame:
    """Station-events with more voters than registered."""
    return events.where(F.col("votants") > F.col("inscrits"))


def check_balance(events: DataFrame, tol: float = 0.02) -> DataFrame:
    """Valid + blank + void differing from turnout by more than ``tol`` (relative)."""
    gap = F.abs((F.col("exprimes") + F.col("blancs") + F.col("nuls") - F.col("votants")) / F.when(F.col("votants") != 0, F.col("votants")))
    return events.withColumn("balance_gap", gap).where(F.col("balance_gap") > tol)


def check_vote_sum(long_df: DataFrame, tol: float = 0.02, *, compat: bool = False) -> DataFrame:
    """Candidate votes vs valid votes per election > ``tol`` (Q8: grouped per dated election, valid
    votes counted once; ``compat`` reproduces the original grouping without the year and summing the
    valid votes once per candidate row)."""
    if compat:
        keys = ["code_bv", "election_type", "round"]
        g = long_df.groupBy(*keys).agg(F.sum("voix").alias("voix"), F.sum("exprimes").alias("exprimes"))
    else:
        keys = ["code_bv", "election_type", "election_year", "round", "date_scrutin"]
        g = long_df.groupBy(*keys).agg(F.sum("voix").alias("voix"), F.max("exprimes").alias("exprimes"))
    gap = F.abs(F.col("voix") - F.col("exprimes")) / F.when(F.col("exprimes") != 0, F.col("exprimes"))
    return g.withColumn("gap", gap).where(F.col("gap") > tol)


def check_mass(df: DataFrame, cols: tuple[str, ...] = TARGET_COLS, tol: float = 0.05) -> DataFrame:
    """Rows whose shares do not sum to 1 +- ``tol`` (nulls count as 0)."""
    s = None
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(0.0))
        s = v if s is None else s + v
    return df.withColumn("mass", s).where(F.abs(F.col("mass") - 1) > tol)


def check_keys(long_df: DataFrame, cand_keys: list[str]) -> DataFrame:
    """Counts of malformed keys (town not 5 chars, station part not 4 chars) and of duplicate candidate
    rows, as (check_name, n) rows (two aggregations unioned: no join)."""
    st = F.substring_index(F.col("code_bv"), "-", -1)
    bad = long_df.agg(
        F.count_if(F.length("commune_code") != 5).alias("n_bad_town"),
        F.count_if(F.length(st) != 4).alias("n_bad_station"),
    ).select(F.expr("stack(2, 'n_bad_town', n_bad_town, 'n_bad_station', n_bad_station) as (check_name, n)"))
    dups = (
        long_df.groupBy(*cand_keys).count().where(F.col("count") > 1)
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n"))
        .select(F.lit("n_dup_rows").alias("check_name"), "n")
    )
    return bad.unionByName(dups)


def check_scope(long_df: DataFrame, towns: list[str], types: list[str], rounds: list[int]) -> DataFrame:
    """Unexpected towns, types and rounds: one ``(kind, value)`` row for each value."""
    def entry(kind, c, allowed):
        return F.struct(F.lit(kind).alias("kind"), F.when(~F.col(c).isin(*allowed), F.col(c).cast("string")).alias("value"))

    found = F.array(entry("town", "commune_code", towns), entry("type", "election_type", types), entry("round", "round", rounds))
    return long_df.select(F.inline(found)).where(F.col("value").isNotNull()).distinct()
