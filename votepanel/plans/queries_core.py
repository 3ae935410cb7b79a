"""Registered queries: flagship panel chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.constants import INDEX_COLS
from votepanel.operators.aggregate import aggregate_event, national_reference
from votepanel.operators.clean import prepare_long
from votepanel.operators.mapping import expand_by_category, normalise_mapping
from votepanel.operators.windows import panel_lags
from votepanel.plans import oracle as O
from votepanel.plans.catalog import register
from votepanel.plans.panel import build_panel, event_category_table
from votepanel.session import r6, round_doubles
from votepanel.sources.tables import fx_long, fx_mapping


def long_table(spark: SparkSession, sf: str, station: int | None = None) -> DataFrame:
    return prepare_long(fx_long(spark, sf, station))


def mapping_table(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_mapping(fx_mapping(spark, sf))


@register("build_panel", O.panel_sql)
def q_build_panel(spark, sf):
    return round_doubles(build_panel(long_table(spark, sf), mapping_table(spark, sf)))


@register(
    "expand_by_category",
    O.with_ctes(O.FX_LONG, O.FX_MAP)
    + """select l.code_commune as commune_code, l.code_bv, l.type_scrutin as election_type, l.annee as election_year,
 l.tour as round, l.date_scrutin, coalesce(m.category,'centre') as category,
 """
    + O.r6("l.voix/coalesce(m.n_blocs,1)")
    + """ as voix_cat, l.exprimes, l.votants, l.inscrits, l.blancs, l.nuls
from fx_long l left join fx_map m on l.code_candidature=m.code_candidature""",
)
def q_expand_by_category(spark, sf):
    ex = expand_by_category(long_table(spark, sf), mapping_table(spark, sf))
    return round_doubles(ex.drop("voix_sixths"))


_LOCAL_COLS = [*INDEX_COLS, "category", "voix_cat", "exprimes", "votants", "inscrits", "blancs", "nuls", "share", "turnout_pct", "blancs_pct", "nuls_pct"]


@register(
    "aggregate_event",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + "select "
    + ", ".join(c if c in (*INDEX_COLS, "category", "exprimes", "votants", "inscrits", "blancs", "nuls") else f"{O.r6(c)} as {c}" for c in _LOCAL_COLS)
    + " from fx_rates",
)
def q_aggregate_event(spark, sf):
    local = aggregate_event(expand_by_category(long_table(spark, sf), mapping_table(spark, sf)))
    return round_doubles(local.select(*_LOCAL_COLS))


@register(
    "national_reference",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, O.FX_NAT)
    + f"select election_type, election_year, round, category, {O.r6('share_nat')} as share_nat, {O.r6('turnout_nat')} as turnout_nat from fx_nat",
)
def q_national_reference(spark, sf):
    local = aggregate_event(expand_by_category(long_table(spark, sf), mapping_table(spark, sf)))
    return round_doubles(national_reference(local))


_LAG_COLS = ["share_lag_any", "share_lag2_any", "share_lag_same_type", "dev_to_nat", "dev_to_nat_lag_any", "dev_to_nat_lag_same_type", "swing_any"]


@register(
    "panel_lags",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, O.FX_NAT, O.FX_EC, O.FX_LAGS)
    + "select code_bv, election_type, election_year, round, category, "
    + ", ".join(f"{O.r6(c)} as {c}" for c in ["share", "share_nat", *_LAG_COLS])
    + " from fx_lags",
)
def q_panel_lags(spark, sf):
    ec = event_category_table(long_table(spark, sf), mapping_table(spark, sf))
    lg = panel_lags(ec)
    return round_doubles(lg.select("code_bv", "election_type", "election_year", "round", "category", "share", "share_nat", *_LAG_COLS))


# ------------------------------------------------------------------ trend forecast family
from votepanel.operators import forecast as FC  # noqa: E402

TARGET_TYPE = "low"
TARGET_YEAR = 2002


def local_table(spark, sf, station: int | None = None):
    return aggregate_event(expand_by_category(long_table(spark, sf, station), mapping_table(spark, sf)))


def _fc_sql(tail: str, *ctes: str) -> str:
    return O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, *O.forecast_history_ctes(TARGET_YEAR), *ctes) + tail


@register("trend_forecast", lambda: O.trend_forecast_sql(TARGET_TYPE, TARGET_YEAR))
def q_trend_forecast(spark, sf):
    return round_doubles(FC.trend_forecast(local_table(spark, sf), TARGET_TYPE, TARGET_YEAR))


@register(
    "project_share",
    lambda: _fc_sql(f"select code_bv, category, {O.r6('raw_share')} as raw_share from fc_shares", O.project_shares_sql(TARGET_TYPE, TARGET_YEAR)),
)
def q_project_share(spark, sf):
    hist = FC.prepare_history(local_table(spark, sf), target_year=TARGET_YEAR)
    return round_doubles(FC.project_shares(hist, TARGET_TYPE, TARGET_YEAR))


@register(
    "project_rate",
    lambda: _fc_sql(
        "select code_bv, " + O.r6("last_inscrits") + " as last_inscrits, "
        + ", ".join(f"{O.r6(c)} as {c}" for c in ("taux_participation", "taux_blancs", "taux_nuls"))
        + " from fc_rates",
        O.project_rates_sql(TARGET_TYPE, TARGET_YEAR),
    ),
)
def q_project_rate(spark, sf):
    hist = FC.prepare_history(local_table(spark, sf), target_year=TARGET_YEAR)
    return round_doubles(FC.project_rates(FC.station_events(hist), TARGET_TYPE, TARGET_YEAR))


_HC = ["inscrits_total", "votants_total", "blancs_total", "nuls_total", "exprimes_total", "abstention_total"]


@register(
    "head_counts",
    lambda: _fc_sql("select code_bv, " + ", ".join(_HC) + " from fc_counts", O.project_rates_sql(TARGET_TYPE, TARGET_YEAR), O.HEAD_COUNTS_SQL),
)
def q_head_counts(spark, sf):
    hist = FC.prepare_history(local_table(spark, sf), target_year=TARGET_YEAR)
    hc = FC.head_counts(FC.project_rates(FC.station_events(hist), TARGET_TYPE, TARGET_YEAR))
    return hc.where(F.col("inscrits_total").isNotNull()).select("code_bv", *_HC)


@register(
    "infer_exprimes",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + """select code_bv, election_type, election_year, round, category,
 case when exprimes is null or exprimes = 0 then sum(voix_cat) over (partition by code_bv, date_scrutin) else exprimes end as exprimes
 from (select code_bv, election_type, election_year, round, date_scrutin, category, voix_cat,
   case when (election_year * 3 + round + cast(right(code_bv, 4) as int)) % 5 = 0 then null else exprimes end as exprimes from fx_rates) d""",
)
def q_infer_exprimes(spark, sf):
    loc = local_table(spark, sf)
    e = F.col("election_year") * 3 + F.col("round") + F.substring("code_bv", -4, 4).cast("int")
    loc = loc.withColumn("exprimes", F.when(e % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("exprimes")))
    out = FC.infer_exprimes(loc)
    return out.select("code_bv", "election_type", "election_year", "round", "category", "exprimes")
