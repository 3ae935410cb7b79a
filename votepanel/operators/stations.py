"""Station-level statistics and descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES
from votepanel.operators.aggregate import nz

EVENT = ("code_bv", "date_scrutin", "election_type", "round")


def pivot_bloc_votes(cand: DataFrame, *, bloc_col: str = "bloc", keys: tuple[str, ...] = EVENT) -> DataFrame:
    """Votes per station-event and bloc as columns ``voix_bloc_{bloc}`` (fixed 7 blocs, missing -> 0)."""
    return cand.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col(bloc_col) == c, F.col("voix"))), F.lit(0.0)).alias(f"voix_bloc_{c}") for c in CATEGORIES]
    )


def station_totals(cand: DataFrame, keys: tuple[str, ...] = EVENT) -> DataFrame:
    """Totals per station-event (order-free: max of the repeated totals; abstentions = registered - turnout
    when the source has no such column)."""
    abst = F.col("abstentions") if "abstentions" in cand.columns else (F.col("inscrits") - F.col("votants"))
    return cand.withColumn("abstentions", abst).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("exprimes", "inscrits", "votants", "abstentions", "blancs", "nuls")]
    )


def station_features(cand: DataFrame, *, bloc_col: str = "bloc") -> DataFrame:
    """Bloc parts over the sum of bloc votes (Q35), turnout, blank/void over turnout, abstention part,
    polarisation (far left + far right) and HHI fragmentation; null ratios -> 0. One aggregation pass."""
    c = cand.withColumn("abstentions", F.col("abstentions") if "abstentions" in cand.columns else F.col("inscrits") - F.col("votants"))
    aggs = [F.coalesce(F.sum(F.when(F.col(bloc_col) == b, F.col("voix"))), F.lit(0.0)).alias(f"voix_bloc_{b}") for b in CATEGORIES]
    aggs += [F.max(x).alias(x) for x in ("exprimes", "inscrits", "votants", "abstentions", "blancs", "nuls")]
    g = c.groupBy(*EVENT).agg(*aggs)
    total = None
    for b in CATEGORIES:
        total = F.col(f"voix_bloc_{b}") if total is None else total + F.col(f"voix_bloc_{b}")
    g = g.withColumn("voix_bloc_total", total)
    den = nz("voix_bloc_total")
    g = g.select("*", *[F.coalesce(F.col(f"voix_bloc_{b}") / den, F.lit(0.0)).alias(f"part_bloc_{b}") for b in CATEGORIES])
    hhi = None
    for b in CATEGORIES:
        sq = F.col(f"part_bloc_{b}") * F.col(f"part_bloc_{b}")
        hhi = sq if hhi is None else hhi + sq
    return g.select(
        "*",
        F.coalesce(F.col("votants") / nz("inscrits"), F.lit(0.0)).alias("taux_participation"),
        F.coalesce(F.col("blancs") / nz("votants"), F.lit(0.0)).alias("part_blancs"),
        F.coalesce(F.col("nuls") / nz("votants"), F.lit(0.0)).alias("part_nuls"),
        F.coalesce(F.col("abstentions") / nz("inscrits"), F.lit(0.0)).alias("part_abstention"),
        F.coalesce((F.col("voix_bloc_extreme_droite") + F.col("voix_bloc_extreme_gauche")) / den, F.lit(0.0)).alias("polarisation"),
        F.coalesce(hhi, F.lit(0.0)).alias("fragmentation_hhi"),
    )


STATION_LAG_BASE = tuple(f"part_bloc_{b}" for b in CATEGORIES) + ("taux_participation", "part_blancs", "part_nuls", "part_abstention")


def station_lags(feat: DataFrame) -> DataFrame:
    """Lag 1 and 2 of every part and rate within the station (time order: date, round, type)."""
    w = Window.partitionBy("code_bv").orderBy("date_scrutin", "round", "election_type")
    return feat.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in STATION_LAG_BASE for k in (1, 2)])


def candidate_dedup(cand: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per station, event, candidate and bloc: max votes, totals = max (order-free first),
    null keys kept as their own group."""
    return cand.groupBy(*keys).agg(
        F.max("voix").alias("voix"), *[F.max(c).alias(c) for c in ("exprimes", "inscrits", "votants", "blancs", "nuls")]
    )


def bureau_event_stats(long_df: DataFrame) -> DataFrame:
    """Max totals per station-event with rates over registered; type trimmed/lowered, round null -> 1."""
    g = long_df.groupBy("code_bv", "election_type", "election_year", "round", "date_scrutin").agg(
        *[F.max(c).alias(c) for c in ("inscrits", "votants", "blancs", "nuls")]
    )
    ins = nz("inscrits")
    return g.select(
        "code_bv",
        F.lower(F.trim("election_type")).alias("election_type"),
        "election_year",
        F.coalesce(F.col("round"), F.lit(1)).alias("round"),
        "date_scrutin",
        "inscrits",
        "votants",
        "blancs",
        "nuls",
        (F.col("votants") / ins).alias("turnout_pct"),
        (F.col("blancs") / ins).alias("blancs_pct"),
        (F.col("nuls") / ins).alias("nuls_pct"),
    )


def default_rates(stats: DataFrame) -> DataFrame:
    """Median turnout / blank / void rates overall (``election_type`` null) and per type, on first-round
    rows when there are any (exact medians, one pass with grouping sets)."""
    has_r1 = stats.where(F.col("round") == 1).limit(1).count() > 0
    s = stats.where(F.col("round") == 1) if has_r1 else stats
    from votepanel.operators.quantiles import exact_quantiles

    rates = ("turnout_pct", "blancs_pct", "nuls_pct")
    long_ = s.select("election_type", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in rates])).alias("x")).select("election_type", "x.*")
    by_type = exact_quantiles(long_, "v", {"m": 0.5}, ("election_type", "rate"))
    overall = exact_quantiles(long_, "v", {"m": 0.5}, ("rate",)).select(F.lit(None).cast("string").alias("election_type"), "rate", "m")
    both = by_type.unionByName(overall)
    return both.groupBy("election_type").agg(*[F.max(F.when(F.col("rate") == r, F.col("m"))).alias(r) for r in rates])


def star_national(local: DataFrame) -> DataFrame:
    """Unweighted mean share and mean turnout per election and category."""
    return local.groupBy("election_type", "election_year", "round", "category").agg(
        F.avg("share").alias("share"), F.avg("turnout_pct").alias("turnout")
    )


def weighted_national(feat: DataFrame, *, type_col: str = "election_type", round_col: str = "round") -> DataFrame:
    """Bloc parts weighted by valid votes per type and round (zero weights ignored)."""
    w = nz("exprimes")
    aggs = []
    for b in CATEGORIES:
        x = F.col(f"part_bloc_{b}")
        aggs.append((F.sum(F.when(x.isNotNull(), x * w)) / F.sum(F.when(x.isNotNull() & w.isNotNull(), w))).alias(f"part_bloc_{b}"))
    return feat.groupBy(type_col, round_col).agg(*aggs)


def local_vs_national(feat: DataFrame, nat: DataFrame) -> DataFrame:
    """Local parts and gaps to the weighted national part, in points rounded to 2 decimals."""
    n = nat.select("election_type", "round", *[F.col(f"part_bloc_{b}").alias(f"_n_{b}") for b in CATEGORIES])
    j = feat.join(n, on=["election_type", "round"], how="left")
    cols = []
    for b in CATEGORIES:
        cols.append((F.col(f"part_bloc_{b}") * 100).alias(b))
        cols.append(((F.col(f"part_bloc_{b}") - F.coalesce(F.col(f"_n_{b}"), F.lit(0.0))) * 100).alias(f"{b}_ecart_nat"))
    return j.select("code_bv", "election_type", "round", "date_scrutin", *cols)


def distinct_stations(long_df: DataFrame) -> DataFrame:
    return long_df.select("commune_code", "code_bv").distinct()


def distinct_events(long_df: DataFrame) -> DataFrame:
    """Elections with their first date and number of stations."""
    return long_df.groupBy("election_type", "election_year", "round").agg(
        F.min("date_scrutin").alias("date_scrutin"), F.count_distinct("code_bv").alias("n_stations")
    )


def describe_votes(long_df: DataFrame) -> DataFrame:
    """Per station: count, mean, sample std and exact quartiles of the valid votes of its elections."""
    ev = long_df.groupBy("code_bv", "election_type", "election_year", "round").agg(F.max("exprimes").alias("exprimes"))
    return ev.groupBy("code_bv").agg(
        F.count("exprimes").alias("count"),
        F.avg("exprimes").alias("mean"),
        F.stddev_samp("exprimes").alias("std"),
        F.min("exprimes").alias("min"),
        F.percentile("exprimes", 0.25).alias("q25"),
        F.percentile("exprimes", 0.5).alias("q50"),
        F.percentile("exprimes", 0.75).alias("q75"),
        F.max("exprimes").alias("max"),
    )


def variation_check(feat: DataFrame, col: str) -> DataFrame:
    """Distinct values of a station-level part per election (1 means the grain is wrong)."""
    return feat.groupBy("election_type", "round", "date_scrutin").agg(F.count_distinct(col).alias("n_distinct"))


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null rate per column in one pass, returned long (column, n_null, null_rate)."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {stack}) as (column_name, n_null)"), "_n").select(
        "column_name", "n_null", (F.col("n_null") / F.col("_n")).alias("null_rate")
    )


def rows_with_nulls_by_town(df: DataFrame, cols: list[str], town_col: str = "code_commune") -> DataFrame:
    any_null = None
    for c in cols:
        e = F.col(c).isNull()
        any_null = e if any_null is None else (any_null | e)
    return df.groupBy(town_col).agg(F.count_if(any_null).alias("n_rows_with_null"), F.count(F.lit(1)).alias("n_rows"))


def premapping(long_df: DataFrame) -> DataFrame:
    """Distinct (source, code, name) triples to be mapped."""
    return long_df.select("election_type", "code_candidature", "nom_candidature").distinct()


def sample_keys(df: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` rows: order by a seeded digest of the key (TakeOrdered: each
    task keeps its n best, the driver merges n x tasks rows)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)
