"""``elections_blocs`` plan (older processed table) and town statistics.

Station-event-bloc grain (Q22 fixed: votes are aggregated per event before lags, so lags step over
elections, not candidate rows). One exchange on ``code_bv`` serves every station window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.operators.aggregate import nz
from votepanel.operators.mapping import expand_by_bloc
from votepanel.session import cut_lineage

BLOC_EVENT_KEYS = ("code_bv", "date_scrutin", "annee", "type_scrutin", "tour", "bloc")


def bloc_event_table(long_df: DataFrame, mapping_lenient: DataFrame, *, broadcast: bool | None = None) -> DataFrame:
    """Votes per station-event-bloc with part and rates over registered."""
    ex = expand_by_bloc(long_df, mapping_lenient, broadcast=broadcast)
    g = ex.groupBy(*BLOC_EVENT_KEYS).agg(
        F.sum("voix_bloc").alias("voix_bloc"),
        F.max("exprimes").alias("exprimes"),
        F.max("inscrits").alias("inscrits"),
        F.max("votants").alias("votants"),
        F.max("blancs").alias("blancs"),
        F.max("nuls").alias("nuls"),
    )
    ins = nz("inscrits")
    return g.select(
        "*",
        (F.col("voix_bloc") / nz("exprimes")).alias("part_bloc"),
        (F.col("votants") / ins).alias("taux_participation_bv"),
        (F.col("blancs") / ins).alias("taux_blancs_bv"),
        (F.col("nuls") / ins).alias("taux_nuls_bv"),
    )


def national_reference_by_date(blocs: DataFrame) -> DataFrame:
    """Reference part and turnout per date and bloc (sums over the rows supplied)."""
    g = blocs.groupBy("date_scrutin", "bloc").agg(
        F.sum("voix_bloc").alias("v"), F.sum("exprimes").alias("e"), F.sum("votants").alias("vt"), F.sum("inscrits").alias("i")
    )
    return g.select(
        "date_scrutin",
        "bloc",
        (F.col("v") / nz("e")).alias("part_bloc_national"),
        (F.col("vt") / nz("i")).alias("taux_participation_national"),
    )


def attach_national(blocs: DataFrame, national: DataFrame | None = None) -> DataFrame:
    """Left join of the (small, checked) reference on date and bloc, plus the two gaps."""
    nat = national_reference_by_date(blocs) if national is None else national
    out = blocs.join((nat), on=["date_scrutin", "bloc"], how="left")
    return out.select(
        "*",
        (F.col("part_bloc") - F.col("part_bloc_national")).alias("ecart_bloc_vs_national"),
        (F.col("taux_participation_bv") - F.col("taux_participation_national")).alias("ecart_participation_vs_nat"),
    )


def town_code(c) -> F.Column:
    """Digits of the town code, left-padded to 5 and cut to 5 characters."""
    return F.substring(F.lpad(F.regexp_replace(c, r"\D", ""), 5, "0"), 1, 5)


def filter_communes(df: DataFrame, communes: DataFrame, *, key_col: str | None = None) -> DataFrame:
    """Keep rows of the target towns and attach their names (semi join by broadcast of the town list).

    ``communes``: ``code_commune, nom_commune`` (already 5-digit codes).
    """
    src = F.col(key_col) if key_col else F.substring_index(F.col("code_bv").cast("string"), "-", 1)
    d = df.withColumn("code_commune", town_code(src.cast("string")))
    return d.join((communes.select("code_commune", "nom_commune")), on="code_commune", how="inner")


def registered_growth(df: DataFrame, base_year: int) -> DataFrame:
    """Growth of the mean registered count of the station-year since ``base_year``."""
    w_year = Window.partitionBy("code_bv", "annee")
    w_st = Window.partitionBy("code_bv")
    mean_year = F.avg("inscrits").over(w_year)
    d = df.withColumn("_ins_year", mean_year)
    base = F.max(F.when(F.col("annee") == base_year, F.col("_ins_year"))).over(w_st)
    d = d.withColumn("_ins_base", base)
    return d.withColumn("croissance_inscrits_depuis_base", (F.col("_ins_year") - F.col("_ins_base")) / nz("_ins_base")).drop(
        "_ins_year", "_ins_base"
    )


def column_median(df: DataFrame, col: str) -> float | None:
    """Exact median of a low-cardinality column; Spark's exact percentile keeps one counter per
    distinct value (not per row), so this stays small however many rows there are."""
    row = df.agg(F.percentile(F.col(col).cast("double"), 0.5).alias("m")).first()
    return None if row is None else row["m"]


def bloc_lags(df: DataFrame, *, median_year: float | None = None) -> DataFrame:
    """Lag 1 of part, gap to reference and turnout per station-bloc; year minus the overall median."""
    w = Window.partitionBy("code_bv", "bloc").orderBy("date_scrutin", "type_scrutin", "tour")
    m = column_median(df, "annee") if median_year is None else median_year
    return df.select(
        "*",
        F.lag("part_bloc", 1).over(w).alias("part_bloc_lag1"),
        F.lag("ecart_bloc_vs_national", 1).over(w).alias("ecart_bloc_vs_national_lag1"),
        F.lag("taux_participation_bv", 1).over(w).alias("taux_participation_bv_lag1"),
        (F.col("annee") - F.lit(m)).alias("annee_centre"),
    )


def build_elections_blocs(
    long_df: DataFrame,
    mapping_lenient: DataFrame,
    communes: DataFrame,
    *,
    base_year: int,
    national: DataFrame | None = None,
) -> DataFrame:
    """expand -> per-event blocs -> reference (all towns) -> target towns -> growth -> lags."""
    # written once: the rows and the reference over them read it
    blocs = attach_national(cut_lineage(bloc_event_table(long_df, mapping_lenient), "bloc_event"), national)
    blocs = filter_communes(blocs, communes).repartition("code_bv")
    return bloc_lags(registered_growth(blocs, base_year))


def commune_event_stats(long_df: DataFrame, communes: DataFrame) -> DataFrame:
    """Max totals per station-event, then sums per town-event, with rates over registered."""
    d = filter_communes(long_df, communes, key_col="commune_code" if "commune_code" in long_df.columns else None)
    ev_keys = ["code_commune", "code_bv", "election_type", "election_year", "round", "date_scrutin"]
    st = d.groupBy(*ev_keys).agg(*[F.max(c).alias(c) for c in ("exprimes", "inscrits", "votants", "blancs", "nuls")])
    town = st.groupBy("code_commune", "election_type", "election_year", "round", "date_scrutin").agg(
        *[F.sum(c).alias(c) for c in ("exprimes", "inscrits", "votants", "blancs", "nuls")]
    )
    ins = nz("inscrits")
    town = town.select(
        "*",
        (F.col("votants") / ins).alias("turnout_pct"),
        (F.col("blancs") / ins).alias("blancs_pct"),
        (F.col("nuls") / ins).alias("nuls_pct"),
    )
    return town.join((communes.select("code_commune", "nom_commune")), on="code_commune", how="left")
