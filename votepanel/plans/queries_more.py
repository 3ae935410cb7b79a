"""Registered queries beyond the flagship chain, family by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.operators.mapping import expand_by_bloc, normalise_mapping
from votepanel.plans import blocs as B
from votepanel.plans import oracle as O
from votepanel.plans.catalog import register
from votepanel.plans.queries_core import long_table
from votepanel.session import round_doubles
from votepanel.sources.tables import fx_mapping, read_table

BASE_YEAR = 1995


def communes_table(spark: SparkSession, sf: str) -> DataFrame:
    """Target towns: the nations of one region (stands for the configured town list)."""
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"]).where(F.col("r_name") == "EUROPE")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code_commune"), F.col("n_name").alias("nom_commune")
    )


def all_towns(spark: SparkSession, sf: str) -> DataFrame:
    """Every town with its name."""
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name"])
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code_commune"), F.col("n_name").alias("nom_commune"))


def lenient_mapping(spark, sf):
    return normalise_mapping(fx_mapping(spark, sf), lenient=True)


_EV_COLS = ["code_bv", "date_scrutin", "annee", "type_scrutin", "tour", "bloc", "voix_bloc", "exprimes", "inscrits", "votants",
            "blancs", "nuls", "part_bloc", "taux_participation_bv", "taux_blancs_bv", "taux_nuls_bv"]
_EV_DBL = {"voix_bloc", "part_bloc", "taux_participation_bv", "taux_blancs_bv", "taux_nuls_bv"}


@register("target_communes", O.with_ctes(O.FB_TOWNS) + "select code_commune, nom_commune from fb_towns")
def q_target_communes(spark, sf):
    return communes_table(spark, sf)


@register(
    "expand_by_bloc",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FB_EX)
    + "select code_bv, date_scrutin, annee, type_scrutin, tour, bloc, " + O.r6("voix_bloc") + " as voix_bloc, "
    + O.r6("voix_bloc/nullif(exprimes,0)") + " as part_bloc, " + O.r6("votants/nullif(inscrits,0)") + " as taux_participation_bv from fb_ex",
)
def q_expand_by_bloc(spark, sf):
    ex = expand_by_bloc(long_table(spark, sf), lenient_mapping(spark, sf))
    return round_doubles(ex.select("code_bv", "date_scrutin", "annee", "type_scrutin", "tour", "bloc", "voix_bloc", "part_bloc", "taux_participation_bv"))


@register("bloc_event_table", O.with_ctes(O.FX_LONG, O.FX_MAP, O.FB_EX, O.FB_EV) + O.select_r6(_EV_COLS, _EV_DBL, "fb_ev"))
def q_bloc_event_table(spark, sf):
    return round_doubles(B.bloc_event_table(long_table(spark, sf), lenient_mapping(spark, sf)).select(*_EV_COLS))


@register(
    "national_reference_by_date",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FB_EX, O.FB_EV, O.FB_NAT)
    + O.select_r6(["date_scrutin", "bloc", "part_bloc_national", "taux_participation_national"], {"part_bloc_national", "taux_participation_national"}, "fb_nat"),
)
def q_national_reference_by_date(spark, sf):
    return round_doubles(B.national_reference_by_date(B.bloc_event_table(long_table(spark, sf), lenient_mapping(spark, sf))))


_ATT = ["code_bv", "date_scrutin", "bloc", "part_bloc_national", "ecart_bloc_vs_national", "ecart_participation_vs_nat"]


@register(
    "join_reference",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FB_EX, O.FB_EV, O.FB_NAT, O.FB_ATT) + O.select_r6(_ATT, set(_ATT[3:]), "fb_att"),
)
def q_join_reference(spark, sf):
    return round_doubles(B.attach_national(B.bloc_event_table(long_table(spark, sf), lenient_mapping(spark, sf))).select(*_ATT))


@register(
    "filter_communes",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FB_TOWNS, O.FB_EX, O.FB_EV, O.FB_NAT, O.FB_ATT, O.FB_TGT)
    + O.select_r6(["code_commune", "nom_commune", "code_bv", "date_scrutin", "bloc", "part_bloc"], {"part_bloc"}, "fb_tgt"),
)
def q_filter_communes(spark, sf):
    ev = B.attach_national(B.bloc_event_table(long_table(spark, sf), lenient_mapping(spark, sf)))
    out = B.filter_communes(ev, communes_table(spark, sf))
    return round_doubles(out.select("code_commune", "nom_commune", "code_bv", "date_scrutin", "bloc", "part_bloc"))


_GROWTH = ["code_bv", "date_scrutin", "type_scrutin", "tour", "bloc", "croissance_inscrits_depuis_base"]


@register("registered_growth", lambda: O.with_ctes(*O.fb_ctes(BASE_YEAR)[:-1]) + O.select_r6(_GROWTH, {"croissance_inscrits_depuis_base"}, "fb_growth"))
def q_registered_growth(spark, sf):
    ev = B.attach_national(B.bloc_event_table(long_table(spark, sf), lenient_mapping(spark, sf)))
    out = B.registered_growth(B.filter_communes(ev, all_towns(spark, sf)).repartition("code_bv"), BASE_YEAR)
    return round_doubles(out.select(*_GROWTH))


_BLOCS = ["code_commune", "nom_commune", "code_bv", "date_scrutin", "annee", "type_scrutin", "tour", "bloc", "voix_bloc", "exprimes",
          "inscrits", "votants", "blancs", "nuls", "part_bloc", "taux_participation_bv", "taux_blancs_bv", "taux_nuls_bv",
          "part_bloc_national", "taux_participation_national", "ecart_bloc_vs_national", "ecart_participation_vs_nat",
          "croissance_inscrits_depuis_base", "part_bloc_lag1", "ecart_bloc_vs_national_lag1", "taux_participation_bv_lag1", "annee_centre"]
_BLOCS_DBL = set(_BLOCS[8:]) - {"exprimes", "inscrits", "votants", "blancs", "nuls"}


@register("build_elections_blocs", lambda: O.with_ctes(*O.fb_ctes(BASE_YEAR, O.FB_TOWNS)) + O.select_r6(_BLOCS, _BLOCS_DBL, "fb_lags"))
def q_build_elections_blocs(spark, sf):
    out = B.build_elections_blocs(long_table(spark, sf), lenient_mapping(spark, sf), communes_table(spark, sf), base_year=BASE_YEAR)
    return round_doubles(out.select(*_BLOCS))


_BLAGS = ["code_bv", "date_scrutin", "type_scrutin", "tour", "bloc", "part_bloc_lag1", "ecart_bloc_vs_national_lag1", "taux_participation_bv_lag1", "annee_centre"]


@register("bloc_lags", lambda: O.with_ctes(*O.fb_ctes(BASE_YEAR)) + O.select_r6(_BLAGS, set(_BLAGS[5:]), "fb_lags"))
def q_bloc_lags(spark, sf):
    return round_doubles(blocs_table(spark, sf).select(*_BLAGS))


_CES = ["code_commune", "nom_commune", "election_type", "election_year", "round", "date_scrutin", "exprimes", "inscrits", "votants",
        "blancs", "nuls", "turnout_pct", "blancs_pct", "nuls_pct"]


@register(
    "commune_event_stats",
    O.with_ctes(O.FX_LONG, O.FB_TOWNS)
    + """, st as (select l.code_commune, l.code_bv, l.type_scrutin as election_type, l.annee as election_year, l.tour as round, l.date_scrutin,
  max(exprimes) as exprimes, max(inscrits) as inscrits, max(votants) as votants, max(blancs) as blancs, max(nuls) as nuls
  from fx_long l where l.code_commune in (select code_commune from fb_towns)
  group by l.code_commune, l.code_bv, l.type_scrutin, l.annee, l.tour, l.date_scrutin),
 tw as (select code_commune, election_type, election_year, round, date_scrutin, sum(exprimes) as exprimes, sum(inscrits) as inscrits,
  sum(votants) as votants, sum(blancs) as blancs, sum(nuls) as nuls from st group by code_commune, election_type, election_year, round, date_scrutin)
select tw.code_commune, t.nom_commune, election_type, election_year, round, date_scrutin, exprimes, inscrits, votants, blancs, nuls, """
    + ", ".join(f"{O.r6(e)} as {n}" for e, n in [("votants/nullif(inscrits,0)", "turnout_pct"), ("blancs/nullif(inscrits,0)", "blancs_pct"), ("nuls/nullif(inscrits,0)", "nuls_pct")])
    + " from tw left join fb_towns t on tw.code_commune = t.code_commune",
)
def q_commune_event_stats(spark, sf):
    return round_doubles(B.commune_event_stats(long_table(spark, sf), communes_table(spark, sf)).select(*_CES))


# ------------------------------------------------------------------ model table family
from votepanel.plans import model_table as MT  # noqa: E402


def blocs_table(spark, sf):
    """The bloc table of every town (``build_elections_blocs`` itself has the target towns)."""
    return B.build_elections_blocs(long_table(spark, sf), lenient_mapping(spark, sf), all_towns(spark, sf), base_year=BASE_YEAR)


def model_frame(spark, sf):
    return MT.model_table(blocs_table(spark, sf))


_MT_KEYS = ["code_bv", "bloc", "date_scrutin", "type_scrutin", "tour"]


def _mt_query(key: str, cols: list[str]):
    @register(key, lambda: O.with_ctes(*O.model_table_sql_ctes(BASE_YEAR)) + O.select_r6(_MT_KEYS + cols, set(cols) - {"month", "dow", "is_2020"}, "mt_final"))
    def q(spark, sf, _cols=cols):
        return round_doubles(model_frame(spark, sf).select(*_MT_KEYS, *_cols))

    return q


_CAL = ["month", "dow", "month_sin", "month_cos", "dow_sin", "dow_cos"]
_MULTI = [f"{p}{k}" for k in MT.LAG_STEPS for p in ("part_bloc_lag", "taux_participation_bv_lag", "ecart_bloc_vs_national_lag")]
_ROLL = [f"{p}_{n}" for n in MT.ROLL_WINDOWS for p in ("part_bloc_roll_mean", "part_bloc_roll_std", "part_bloc_roll_max", "taux_participation_roll_mean")]
_TREND = ["y_lag1_bv", "y_lag2_bv", "y_rollmean_3_bv", "y_trend_bv"]
_INTER = ["voix_bloc_sur_inscrits", "exprimes_sur_inscrits", "votants_sur_inscrits", "part_bloc_lag1_x_participation",
          "part_bloc_lag1_x_ecart_nat", "participation_x_ecart_nat", "part_bloc_trend_1", "part_bloc_trend_2"]
_mt_query("calendar_features", _CAL)
_mt_query("multi_lags", _MULTI)
_mt_query("rolling_prior", _ROLL)
_mt_query("station_trend", _TREND)
_mt_query("town_lag", ["y_comm_lag1"])
_mt_query("interaction_features", _INTER)
_mt_query("base_table_rules", ["is_2020", "annee_centre", "part_bloc"])
_mt_query("model_table", ["is_2020", "annee_centre", "part_bloc", *_CAL, *_MULTI, *_ROLL, *_TREND, "y_comm_lag1", *_INTER])


@register(
    "town_weighted_avg",
    lambda: O.with_ctes(*O.model_table_sql_ctes(BASE_YEAR)[:-2])
    + """select code_commune, bloc, date_scrutin, """ + O.r6("""case when count(part_bloc) > 0 and count(part_bloc) = count(*) then
     sum(part_bloc * greatest(coalesce(exprimes,1.0),1.0)) / sum(case when part_bloc is not null then greatest(coalesce(exprimes,1.0),1.0) end) end""")
    + " as y_comm from mt_lags group by code_commune, bloc, date_scrutin",
)
def q_town_weighted_avg(spark, sf):
    base = MT.base_table_rules(blocs_table(spark, sf))
    return round_doubles(MT.town_weighted_avg(base))


# ------------------------------------------------------------------ scoring / as-of family
from votepanel.plans import scoring as SC  # noqa: E402
from votepanel.plans.panel import event_category_table  # noqa: E402
from votepanel.plans.queries_core import TARGET_TYPE, TARGET_YEAR, local_table, mapping_table  # noqa: E402
from votepanel.operators import forecast as FC  # noqa: E402

SCORE_YEAR = 2000


def history_table(spark, sf):
    return event_category_table(long_table(spark, sf), mapping_table(spark, sf))


@register("score_features", lambda: O.score_features_sql(TARGET_TYPE, SCORE_YEAR))
def q_score_features(spark, sf):
    return round_doubles(SC.score_features(history_table(spark, sf), TARGET_TYPE, SCORE_YEAR))


_SC_HIST = O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, O.FX_NAT, O.FX_EC)


@register(
    "asof_last_event",
    _SC_HIST
    + f"""select code_bv, category,
 {O.r6("arg_max(share, date_scrutin) filter (where share is not null)")} as last_share_any,
 {O.r6("arg_max(share - share_nat, date_scrutin) filter (where share - share_nat is not null)")} as last_dev_any,
 {O.r6(f"arg_max(share, date_scrutin) filter (where share is not null and election_type = '{TARGET_TYPE}')")} as last_share_type,
 {O.r6(f"arg_max(share - share_nat, date_scrutin) filter (where share - share_nat is not null and election_type = '{TARGET_TYPE}')")} as last_dev_type
 from fx_ec where election_year < {SCORE_YEAR} group by code_bv, category""",
)
def q_asof_last_event(spark, sf):
    h = SC.filter_history(history_table(spark, sf), SCORE_YEAR)
    return round_doubles(SC.asof_last_event(h, TARGET_TYPE))


@register(
    "swing_last_two",
    _SC_HIST
    + f""", r as (select *, row_number() over (partition by code_bv, category order by date_scrutin desc, election_type desc, round desc) as rn
 from fx_ec where election_year < {SCORE_YEAR})
 select code_bv, category, {O.r6("max(case when rn = 1 then share end) - max(case when rn = 2 then share end)")} as swing_any
 from r group by code_bv, category""",
)
def q_swing_last_two(spark, sf):
    h = SC.filter_history(history_table(spark, sf), SCORE_YEAR)
    return round_doubles(SC.swing_last_two(h))


@register(
    "latest_rows",
    _SC_HIST
    + f""", r as (select *, row_number() over (partition by code_bv, category order by date_scrutin desc, election_type desc, round desc) as rn from fx_ec)
 select code_bv, category, election_type, election_year, round, {O.r6("share")} as share from r where rn = 1""",
)
def q_latest_rows(spark, sf):
    h = history_table(spark, sf)
    out = SC.latest_rows(h, ("code_bv", "category"), ("date_scrutin", "election_type", "round"))
    return round_doubles(out.select("code_bv", "category", "election_type", "election_year", "round", "share"))


_WIN_SQL = """, wr as (select *, row_number() over (partition by code_bv, election_type, election_year, round
   order by share desc nulls last, case category when 'centre' then 0 when 'gauche_modere' then 1 when 'droite_modere' then 2
   when 'gauche_dure' then 3 when 'droite_dure' then 4 when 'extreme_gauche' then 5 else 6 end) as rn from fx_ec)"""


@register(
    "winner",
    _SC_HIST + _WIN_SQL + f""" select code_bv, election_type, election_year, round, category as winner, {O.r6("share")} as winner_share from wr where rn = 1""",
)
def q_winner(spark, sf):
    h = history_table(spark, sf)
    return round_doubles(SC.winner(h, ("code_bv", "election_type", "election_year", "round")))


@register(
    "filter_history",
    _SC_HIST + f"select code_bv, category, election_type, election_year, round, {O.r6('share')} as share from fx_ec where election_year < {SCORE_YEAR} and commune_code = '00003'",
)
def q_filter_history(spark, sf):
    h = SC.filter_history(history_table(spark, sf), SCORE_YEAR, "00003")
    return round_doubles(h.select("code_bv", "category", "election_type", "election_year", "round", "share"))


_LEG, _MUN, _MUN_YEAR = "high", "medium", 2000


def _preds_long(spark, sf):
    tf = FC.trend_forecast(local_table(spark, sf), TARGET_TYPE, TARGET_YEAR)
    return tf.where(F.col("predicted_share").isNotNull()).select(
        F.substring_index("code_bv", "-", 1).alias("commune_code"), "code_bv", F.col("categorie").alias("category"), "predicted_share"
    )


@register(
    "join_last_refs",
    lambda: O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + f""", tf as ({O.trend_forecast_sql(TARGET_TYPE, TARGET_YEAR)}),
 leg as (select code_bv, category, arg_max(share, date_scrutin) as ref_leg from fx_rates where election_type = '{_LEG}' and election_year < {TARGET_YEAR} group by code_bv, category),
 mun as (select code_bv, category, arg_max(share, date_scrutin) as ref_mun from fx_rates where election_type = '{_MUN}' and election_year = {_MUN_YEAR} group by code_bv, category)
 select split_part(t.code_bv, '-', 1) as commune_code, t.code_bv, t.categorie as category, t.predicted_share, {O.r6('leg.ref_leg')} as ref_leg, {O.r6('mun.ref_mun')} as ref_mun
 from tf t left join leg on t.code_bv = leg.code_bv and t.categorie = leg.category left join mun on t.code_bv = mun.code_bv and t.categorie = mun.category
 where t.predicted_share is not null""",
)
def q_join_last_refs(spark, sf):
    out = SC.join_last_refs(_preds_long(spark, sf), local_table(spark, sf), leg_type=_LEG, mun_type=_MUN, mun_year=_MUN_YEAR, target_year=TARGET_YEAR)
    return round_doubles(out)


def _predict_output_sql() -> str:
    from votepanel.constants import CATEGORIES

    inner = O.trend_forecast_sql(TARGET_TYPE, TARGET_YEAR, report=False)
    cols = []
    for c in CATEGORIES:
        cols += [
            f"max(case when category = '{c}' then {O.r6('p * 100')} end) as predicted_share_{c}",
            f"max(case when category = '{c}' then {O.r6('p * 100 - ref_leg * 100')} end) as delta_leg_{c}",
            f"max(case when category = '{c}' then {O.r6('p * 100 - ref_mun * 100')} end) as delta_mun2020_{c}",
        ]
    return (
        O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
        + f""", tf as ({inner}),
 leg as (select code_bv, category, arg_max(share, date_scrutin) as ref_leg from fx_rates where election_type = '{_LEG}' and election_year < {TARGET_YEAR} group by code_bv, category),
 mun as (select code_bv, category, arg_max(share, date_scrutin) as ref_mun from fx_rates where election_type = '{_MUN}' and election_year = {_MUN_YEAR} group by code_bv, category),
 j as (select split_part(t.code_bv, '-', 1) as commune_code, t.code_bv, t.categorie as category, t.predicted_share as p, leg.ref_leg, mun.ref_mun
  from tf t left join leg on t.code_bv = leg.code_bv and t.categorie = leg.category left join mun on t.code_bv = mun.code_bv and t.categorie = mun.category
  where t.predicted_share is not null)
 select commune_code, code_bv, {', '.join(cols)} from j group by commune_code, code_bv"""
    )


@register("predict_output", _predict_output_sql)
def q_predict_output(spark, sf):
    j = SC.join_last_refs(_preds_long(spark, sf), local_table(spark, sf), leg_type=_LEG, mun_type=_MUN, mun_year=_MUN_YEAR, target_year=TARGET_YEAR)
    # report rule of the registry (6 decimals); the 2-decimal display rounding is unit-tested
    return round_doubles(SC.predict_output(j, decimals=None))


# ------------------------------------------------------------------ station statistics family
from votepanel.operators import quality as QC  # noqa: E402
from votepanel.operators import stations as ST  # noqa: E402
from votepanel.operators.aggregate import aggregate_event  # noqa: E402
from votepanel.operators.clean import prepare_long  # noqa: E402
from votepanel.operators.mapping import expand_by_category  # noqa: E402
from votepanel.sources.tables import fx_dirty  # noqa: E402


def first_bloc_candidates(spark, sf, *, dirty: bool = False):
    """Candidate rows with the first mapped bloc of their party (unmapped -> centre)."""
    lg = prepare_long(fx_dirty(spark, sf)) if dirty else long_table(spark, sf)
    m = mapping_table(spark, sf).select("code_candidature", "bloc_1")

    j = lg.join((m), on="code_candidature", how="left")
    return j.withColumn("bloc", F.coalesce(F.col("bloc_1"), F.lit("centre"))).drop("bloc_1")


FS_CAND = """fs_cand as (
 select l.code_bv, l.date_scrutin, l.type_scrutin as election_type, l.tour as round, l.annee as election_year, l.code_candidature,
  l.voix, l.exprimes, l.inscrits, l.votants, l.blancs, l.nuls, coalesce(m.category, 'centre') as bloc
 from fx_long l left join (select * from fx_map where k = 0) m on l.code_candidature = m.code_candidature)"""

_FS_KEYS = "code_bv, date_scrutin, election_type, round"
_CATS = ["centre", "gauche_modere", "droite_modere", "gauche_dure", "droite_dure", "extreme_gauche", "extreme_droite"]


def _fs_feat_sql() -> str:
    vb = ", ".join(f"coalesce(sum(case when bloc = '{b}' then voix end), 0.0) as voix_bloc_{b}" for b in _CATS)
    tot = " + ".join(f"voix_bloc_{b}" for b in _CATS)
    parts = ", ".join(f"coalesce(voix_bloc_{b} / nullif(voix_bloc_total, 0), 0.0) as part_bloc_{b}" for b in _CATS)
    hhi = " + ".join(f"part_bloc_{b} * part_bloc_{b}" for b in _CATS)
    return f"""fs_g as (select {_FS_KEYS}, {vb}, max(exprimes) as exprimes, max(inscrits) as inscrits, max(votants) as votants,
  max(inscrits - votants) as abstentions, max(blancs) as blancs, max(nuls) as nuls from fs_cand group by {_FS_KEYS}),
 fs_t as (select *, {tot} as voix_bloc_total from fs_g),
 fs_p as (select *, {parts} from fs_t),
 fs_feat as (select *, coalesce(votants / nullif(inscrits, 0), 0.0) as taux_participation, coalesce(blancs / nullif(votants, 0), 0.0) as part_blancs,
  coalesce(nuls / nullif(votants, 0), 0.0) as part_nuls, coalesce(abstentions / nullif(inscrits, 0), 0.0) as part_abstention,
  coalesce((voix_bloc_extreme_droite + voix_bloc_extreme_gauche) / nullif(voix_bloc_total, 0), 0.0) as polarisation,
  coalesce({hhi}, 0.0) as fragmentation_hhi from fs_p)"""


_FS_BASE = lambda: O.with_ctes(O.FX_LONG, O.FX_MAP, FS_CAND, _fs_feat_sql())
_EVK = ["code_bv", "date_scrutin", "election_type", "round"]


@register("pivot_bloc_votes", lambda: _FS_BASE() + "select " + _FS_KEYS + ", " + ", ".join(f"voix_bloc_{b}" for b in _CATS) + " from fs_g")
def q_pivot_bloc_votes(spark, sf):
    return ST.pivot_bloc_votes(first_bloc_candidates(spark, sf))


@register("station_totals", lambda: _FS_BASE() + "select " + _FS_KEYS + ", exprimes, inscrits, votants, abstentions, blancs, nuls from fs_g")
def q_station_totals(spark, sf):
    return ST.station_totals(first_bloc_candidates(spark, sf))


_FEAT = [f"part_bloc_{b}" for b in _CATS] + ["voix_bloc_total", "taux_participation", "part_blancs", "part_nuls", "part_abstention", "polarisation", "fragmentation_hhi"]


@register("station_features", lambda: _FS_BASE() + O.select_r6(_EVK + _FEAT, set(_FEAT), "fs_feat"))
def q_station_features(spark, sf):
    return round_doubles(ST.station_features(first_bloc_candidates(spark, sf)).select(*_EVK, *_FEAT))


_SLAGS = [f"{c}_lag{k}" for c in ST.STATION_LAG_BASE for k in (1, 2)]


@register(
    "station_lags",
    lambda: _FS_BASE()
    + ", fs_l as (select *, " + ", ".join(f"lag({c}, {k}) over (partition by code_bv order by date_scrutin, round, election_type) as {c}_lag{k}" for c in ST.STATION_LAG_BASE for k in (1, 2))
    + " from fs_feat) " + O.select_r6(_EVK + _SLAGS, set(_SLAGS), "fs_l"),
)
def q_station_lags(spark, sf):
    return round_doubles(ST.station_lags(ST.station_features(first_bloc_candidates(spark, sf))).select(*_EVK, *_SLAGS))


_WN = [f"part_bloc_{b}" for b in _CATS]


@register(
    "weighted_national",
    lambda: _FS_BASE() + "select election_type, round, "
    + ", ".join(f"{O.r6(f'sum(case when part_bloc_{b} is not null then part_bloc_{b} * nullif(exprimes, 0) end) / sum(case when part_bloc_{b} is not null and nullif(exprimes, 0) is not null then nullif(exprimes, 0) end)')} as part_bloc_{b}" for b in _CATS)
    + " from fs_feat group by election_type, round",
)
def q_weighted_national(spark, sf):
    return round_doubles(ST.weighted_national(ST.station_features(first_bloc_candidates(spark, sf))))


_LVN = [x for b in _CATS for x in (b, f"{b}_ecart_nat")]


@register(
    "local_vs_national",
    lambda: _FS_BASE()
    + ", nat as (select election_type, round, "
    + ", ".join(f"sum(case when part_bloc_{b} is not null then part_bloc_{b} * nullif(exprimes, 0) end) / sum(case when part_bloc_{b} is not null and nullif(exprimes, 0) is not null then nullif(exprimes, 0) end) as n_{b}" for b in _CATS)
    + " from fs_feat group by election_type, round) select f.code_bv, f.election_type, f.round, f.date_scrutin, "
    + ", ".join(f"{O.r6(f'f.part_bloc_{b} * 100')} as {b}, {O.r6(f'(f.part_bloc_{b} - coalesce(n.n_{b}, 0.0)) * 100')} as {b}_ecart_nat" for b in _CATS)
    + " from fs_feat f left join nat n on f.election_type = n.election_type and f.round = n.round",
)
def q_local_vs_national(spark, sf):
    feat = ST.station_features(first_bloc_candidates(spark, sf))
    return round_doubles(ST.local_vs_national(feat, ST.weighted_national(feat)))


_BES = ["code_bv", "election_type", "election_year", "round", "date_scrutin", "inscrits", "votants", "blancs", "nuls", "turnout_pct", "blancs_pct", "nuls_pct"]
BES_SQL = """bes as (select code_bv, lower(trim(type_scrutin)) as election_type, annee as election_year, coalesce(tour, 1) as round, date_scrutin,
  max(inscrits) as inscrits, max(votants) as votants, max(blancs) as blancs, max(nuls) as nuls,
  max(votants) / nullif(max(inscrits), 0) as turnout_pct, max(blancs) / nullif(max(inscrits), 0) as blancs_pct, max(nuls) / nullif(max(inscrits), 0) as nuls_pct
 from fx_long group by code_bv, type_scrutin, annee, tour, date_scrutin)"""


@register("bureau_event_stats", O.with_ctes(O.FX_LONG, BES_SQL) + O.select_r6(_BES, {"turnout_pct", "blancs_pct", "nuls_pct"}, "bes"))
def q_bureau_event_stats(spark, sf):
    return round_doubles(ST.bureau_event_stats(long_table(spark, sf)).select(*_BES))


@register(
    "default_rates",
    O.with_ctes(O.FX_LONG, BES_SQL)
    + f"""select election_type, {O.r6('median(turnout_pct)')} as turnout_pct, {O.r6('median(blancs_pct)')} as blancs_pct, {O.r6('median(nuls_pct)')} as nuls_pct
 from bes where round = 1 group by rollup(election_type)""",
)
def q_default_rates(spark, sf):
    return round_doubles(ST.default_rates(ST.bureau_event_stats(long_table(spark, sf))))


@register(
    "star_national",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + f"select election_type, election_year, round, category, {O.r6('avg(share)')} as share, {O.r6('avg(turnout_pct)')} as turnout from fx_rates group by election_type, election_year, round, category",
)
def q_star_national(spark, sf):
    return round_doubles(ST.star_national(local_table(spark, sf)))


@register(
    "turnout_event",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + f"select commune_code, code_bv, election_type, election_year, round, date_scrutin, {O.r6('max(turnout_pct)')} as turnout_pct from fx_rates group by all",
)
def q_turnout_event(spark, sf):
    from votepanel.operators.aggregate import turnout_event

    return round_doubles(turnout_event(local_table(spark, sf)))


@register("distinct_stations", O.with_ctes(O.FX_LONG) + "select distinct code_commune as commune_code, code_bv from fx_long")
def q_distinct_stations(spark, sf):
    return ST.distinct_stations(long_table(spark, sf))


@register(
    "distinct_events",
    O.with_ctes(O.FX_LONG) + "select type_scrutin as election_type, annee as election_year, tour as round, min(date_scrutin) as date_scrutin, count(distinct code_bv) as n_stations from fx_long group by all",
)
def q_distinct_events(spark, sf):
    return ST.distinct_events(long_table(spark, sf))


@register(
    "describe_votes",
    O.with_ctes(O.FX_LONG)
    + """, ev as (select code_bv, type_scrutin, annee, tour, max(exprimes) as exprimes from fx_long group by all)
 select code_bv, count(exprimes) as count, """
    + ", ".join(f"{O.r6(e)} as {n}" for e, n in [("avg(exprimes)", "mean"), ("stddev_samp(exprimes)", "std"), ("min(exprimes)", "min"),
                                                  ("quantile_cont(exprimes, 0.25)", "q25"), ("quantile_cont(exprimes, 0.5)", "q50"),
                                                  ("quantile_cont(exprimes, 0.75)", "q75"), ("max(exprimes)", "max")])
    + " from ev group by code_bv",
)
def q_describe_votes(spark, sf):
    return round_doubles(ST.describe_votes(long_table(spark, sf)))


@register(
    "variation_check",
    lambda: _FS_BASE() + "select election_type, round, date_scrutin, count(distinct part_bloc_extreme_droite) as n_distinct from fs_feat group by all",
)
def q_variation_check(spark, sf):
    return ST.variation_check(ST.station_features(first_bloc_candidates(spark, sf)), "part_bloc_extreme_droite")


_NP_COLS = ["code_candidature", "voix", "exprimes", "inscrits", "votants", "blancs", "nuls"]
FXD_PREP = """fxd as (select code_commune, code_bv, type_scrutin as election_type, annee as election_year, tour as round, date_scrutin,
  case when upper(trim(code_candidature)) in ('NAN', 'NONE', '', '<NA>') then null else upper(trim(code_candidature)) end as code_candidature,
  voix, exprimes, blancs, nuls, votants, inscrits from fx_dirty)"""


@register(
    "null_profile",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY, FXD_PREP)
    + " union all ".join(f"select '{c}' as column_name, cast(count_if({c} is null) as bigint) as n_null, {O.r6(f'count_if({c} is null) / count(*)')} as null_rate from fxd" for c in _NP_COLS),
)
def q_null_profile(spark, sf):
    return round_doubles(ST.null_profile(prepare_long(fx_dirty(spark, sf)), _NP_COLS))


@register(
    "rows_with_nulls_by_town",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY, FXD_PREP)
    + "select code_commune, cast(count_if(" + " or ".join(f"{c} is null" for c in _NP_COLS) + ") as bigint) as n_rows_with_null, count(*) as n_rows from fxd group by code_commune",
)
def q_rows_with_nulls_by_town(spark, sf):
    d = prepare_long(fx_dirty(spark, sf)).withColumnRenamed("commune_code", "code_commune")
    return ST.rows_with_nulls_by_town(d, _NP_COLS)


@register("premapping", O.with_ctes(O.FX_LONG) + "select distinct type_scrutin as election_type, upper(trim(code_candidature)) as code_candidature, cast(null as varchar) as nom_candidature from fx_long")
def q_premapping(spark, sf):
    return ST.premapping(long_table(spark, sf))


@register(
    "candidate_dedup",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_DIRTY, FXD_PREP)
    + """select d.code_bv, d.election_type, d.election_year, d.round, d.code_candidature, coalesce(m.category, 'centre') as bloc,
 max(d.voix) as voix, max(d.exprimes) as exprimes, max(d.inscrits) as inscrits, max(d.votants) as votants, max(d.blancs) as blancs, max(d.nuls) as nuls
 from fxd d left join (select * from fx_map where k = 0) m on d.code_candidature = upper(m.code_candidature)
 group by d.code_bv, d.election_type, d.election_year, d.round, d.code_candidature, coalesce(m.category, 'centre')""",
)
def q_candidate_dedup(spark, sf):
    c = first_bloc_candidates(spark, sf, dirty=True)
    return ST.candidate_dedup(c, ("code_bv", "election_type", "election_year", "round", "code_candidature", "bloc"))


# ------------------------------------------------------------------ data-quality checks
FXD_EV = """fxd_ev as (select code_bv, election_type, election_year, round, max(exprimes) as exprimes, max(blancs) as blancs,
  max(nuls) as nuls, max(votants) as votants, max(inscrits) as inscrits from fxd group by all)"""


def dirty_events(spark, sf):
    d = prepare_long(fx_dirty(spark, sf))
    return d.groupBy("code_bv", "election_type", "election_year", "round").agg(
        *[F.max(c).alias(c) for c in ("exprimes", "blancs", "nuls", "votants", "inscrits")]
    )


@register("check_turnout_bound", O.with_ctes(O.FX_LONG, O.FX_DIRTY, FXD_PREP, FXD_EV) + "select * from fxd_ev where votants > inscrits")
def q_check_turnout_bound(spark, sf):
    return QC.check_turnout_bound(dirty_events(spark, sf))


@register(
    "check_balance",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY, FXD_PREP, FXD_EV)
    + f""", u as (select * replace (case when cast(right(code_bv, 4) as int) % 9 = 0 then blancs + 50.0 else blancs end as blancs) from fxd_ev),
 g as (select *, abs((exprimes + blancs + nuls - votants) / nullif(votants, 0)) as balance_gap from u) select * replace ({O.r6('balance_gap')} as balance_gap) from g where balance_gap > 0.02""",
)
def q_check_balance(spark, sf):
    """Every ninth station reports 50 blank votes too many; the other stations balance."""
    over = F.substring("code_bv", -4, 4).cast("int") % 9 == 0
    events = dirty_events(spark, sf).withColumn("blancs", F.when(over, F.col("blancs") + 50.0).otherwise(F.col("blancs")))
    return round_doubles(QC.check_balance(events))


@register(
    "check_vote_sum",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY, FXD_PREP)
    + f""", g as (select code_bv, election_type, election_year, round, date_scrutin, sum(voix) as voix, max(exprimes) as exprimes from fxd group by all),
 h as (select *, abs(voix - exprimes) / nullif(exprimes, 0) as gap from g)
 select * replace ({O.r6('gap')} as gap) from h where gap > 0.02""",
)
def q_check_vote_sum(spark, sf):
    return round_doubles(QC.check_vote_sum(prepare_long(fx_dirty(spark, sf))))


@register(
    "check_mass",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY, FXD_PREP, O.FX_MAP)
    + """, loc as (select d.code_bv, d.election_type, d.election_year, d.round, coalesce(m.category, 'centre') as category,
   (coalesce(sum(d.voix * cast(6 / coalesce(m.n_blocs, 1) as int)), 0.0) / cast(6 as double)) / nullif(max(d.exprimes), 0) as share
  from fxd d left join fx_map m on d.code_candidature = upper(m.code_candidature) group by all),
 w as (select code_bv, election_type, election_year, round, """
    + ", ".join(f"avg(case when category = '{c}' then share end) as target_share_{c}" for c in _CATS)
    + " from loc group by all), x as (select *, " + " + ".join(f"coalesce(target_share_{c}, 0.0)" for c in _CATS)
    + " as mass from w) select code_bv, election_type, election_year, round, " + O.r6("mass") + " as mass from x where abs(mass - 1) > 0.05",
)
def q_check_mass(spark, sf):
    from votepanel.operators.reshape import pivot_category

    lg = prepare_long(fx_dirty(spark, sf))
    loc = aggregate_event(expand_by_category(lg, mapping_table(spark, sf)))
    w = pivot_category(loc, ["code_bv", "election_type", "election_year", "round"], [("target_share_", "share")])
    return round_doubles(QC.check_mass(w).select("code_bv", "election_type", "election_year", "round", "mass"))


@register(
    "check_keys",
    O.with_ctes(O.FX_LONG)
    + """select 'n_bad_town' as check_name, cast(count_if(length(code_commune) != 5) as bigint) as n from fx_long
 union all select 'n_bad_station', cast(count_if(length(split_part(code_bv, '-', -1)) != 4) as bigint) from fx_long
 union all select 'n_dup_rows', coalesce(sum(c - 1), 0)::bigint from (select count(*) as c from fx_long group by code_bv, type_scrutin, annee, tour, code_candidature having count(*) > 1) d""",
)
def q_check_keys(spark, sf):
    return QC.check_keys(long_table(spark, sf), ["code_bv", "election_type", "election_year", "round", "code_candidature"])


_SCOPE_TOWNS, _SCOPE_TYPES, _SCOPE_ROUNDS = ["00000", "00001", "00002"], ["low", "high", "medium", "urgent"], [1]


@register(
    "check_scope",
    O.with_ctes(O.FX_LONG)
    + """select distinct 'town' as kind, code_commune as value from fx_long where code_commune not in ('00000', '00001', '00002')
 union all select distinct 'type', type_scrutin from fx_long where type_scrutin not in ('low', 'high', 'medium', 'urgent')
 union all select distinct 'round', cast(tour as varchar) from fx_long where tour <> 1""",
)
def q_check_scope(spark, sf):
    return QC.check_scope(long_table(spark, sf), _SCOPE_TOWNS, _SCOPE_TYPES, _SCOPE_ROUNDS)


# ------------------------------------------------------------------ evaluation family (naive last-value predictor)
from votepanel.operators import folds as FO  # noqa: E402
from votepanel.operators import metrics as ME  # noqa: E402
from votepanel.operators.windows import panel_lags  # noqa: E402


def naive_diag(spark, sf):
    """Naive predictor: the station's previous share of the category (lag 1, any type)."""
    lg = panel_lags(history_table(spark, sf))
    return lg.where(F.col("share").isNotNull() & F.col("share_lag_any").isNotNull()).select(
        "code_bv", "election_type", "election_year", "round", "date_scrutin", "category",
        F.col("share").alias("y_true"), F.col("share_lag_any").alias("y_pred"), F.col("exprimes").alias("weight"),
    )


DIAG = """diag as (select code_bv, election_type, election_year, round, date_scrutin, category, share as y_true, share_lag_any as y_pred, exprimes as weight
 from fx_lags where share is not null and share_lag_any is not null)"""
_OSUM = "list_reduce(list_sort(list(least(greatest(y_pred, 0.0), 1.0)) over (partition by code_bv, election_type, election_year, round)), lambda a, b: a + b)"
DIAG_N = f"""diagn as (select * replace (least(greatest(y_pred, 0.0), 1.0) / case when {_OSUM} = 0 then 1.0 else {_OSUM} end as y_pred) from diag)"""
_EV_BASE = O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, O.FX_NAT, O.FX_EC, O.FX_LAGS, DIAG, DIAG_N)
_DIAG_COLS = ["code_bv", "election_type", "election_year", "round", "category", "y_true", "y_pred", "weight"]


@register("naive_last", _EV_BASE + O.select_r6(_DIAG_COLS, {"y_true", "y_pred"}, "diag"))
def q_naive_last(spark, sf):
    return round_doubles(naive_diag(spark, sf).select(*_DIAG_COLS))


@register("normalise_predictions", _EV_BASE + O.select_r6(_DIAG_COLS, {"y_true", "y_pred"}, "diagn"))
def q_normalise_predictions(spark, sf):
    return round_doubles(ME.normalise_predictions(naive_diag(spark, sf)).select(*_DIAG_COLS))


@register(
    "normalise_in_station",
    _EV_BASE + f"""select code_bv, election_type, election_year, round, category,
 {O.r6("least(greatest(y_pred, 0.0), 1.0) / greatest(" + _OSUM + ", 1e-9)")} as p_norm from diag""",
)
def q_normalise_in_station(spark, sf):
    out = ME.normalise_in_station(naive_diag(spark, sf), keys=("code_bv", "election_type", "election_year", "round"))
    return round_doubles(out.select("code_bv", "election_type", "election_year", "round", "category", "p_norm"))


def _metric_sql() -> str:
    cats = ["centre", "gauche_modere", "droite_modere", "gauche_dure", "droite_dure", "extreme_gauche", "extreme_droite"]
    e = "(y_pred - y_true)"
    cols = [
        (f"avg(abs{e})", "mae_mean"), (f"sqrt(avg({e}*{e}))", "rmse"), (f"quantile_cont(abs{e}, 0.5)", "medae"),
        (f"case when count(*) > 1 then 1 - sum({e}*{e}) / (var_pop(y_true) * count(*)) end", "r2"),
        ("case when count(*) > 1 then 1 - var_pop(y_true - y_pred) / var_pop(y_true) end", "explained_var"),
        (f"case when sum(abs(y_true)) > 0 then sum(abs{e}) / sum(abs(y_true)) end", "wape"),
        (f"avg(2 * abs{e} / (abs(y_true) + abs(y_pred) + 1e-9))", "smape"), (f"avg{e}", "bias"),
    ] + [(f"avg(case when category = '{c}' then abs{e} end)", f"mae_{c}") for c in cats]
    return _EV_BASE + "select " + ", ".join(f"{O.r6(x)} as {n}" for x, n in cols) + " from diagn"


@register("regression_metrics", _metric_sql)
def q_regression_metrics(spark, sf):
    return round_doubles(ME.regression_metrics(ME.normalise_predictions(naive_diag(spark, sf))))


@register("weighted_mae", _EV_BASE + f"select {O.r6('sum(abs(y_true - y_pred) * weight) / sum(weight)')} as weighted_mae from diag")
def q_weighted_mae(spark, sf):
    return round_doubles(ME.weighted_mae(naive_diag(spark, sf)))


_CAT_IDX = """case category when 'centre' then 0 when 'gauche_modere' then 1 when 'droite_modere' then 2 when 'gauche_dure' then 3
 when 'droite_dure' then 4 when 'extreme_gauche' then 5 else 6 end"""


@register(
    "winner_accuracy",
    _EV_BASE + f""", wt as (select code_bv, election_type, election_year, round, category,
   row_number() over (partition by code_bv, election_type, election_year, round order by y_true desc, {_CAT_IDX}) as rt,
   row_number() over (partition by code_bv, election_type, election_year, round order by y_pred desc, {_CAT_IDX}) as rp from diag),
 w as (select code_bv, election_type, election_year, round, max(case when rt = 1 then category end) as a, max(case when rp = 1 then category end) as b
   from wt group by all)
 select {O.r6('avg(case when a = b then 1.0 else 0.0 end)')} as winner_accuracy, count(*) as n_events from w""",
)
def q_winner_accuracy(spark, sf):
    return round_doubles(ME.winner_accuracy(naive_diag(spark, sf)))


@register(
    "error_by_group",
    _EV_BASE + f"""select 'bloc' as dimension, category as key, {O.r6('avg(abs(y_pred - y_true))')} as mae, count(*) as n from diag group by category
 union all select 'year', cast(election_year as varchar), {O.r6('avg(abs(y_pred - y_true))')}, count(*) from diag group by election_year
 union all select 'election_type', election_type, {O.r6('avg(abs(y_pred - y_true))')}, count(*) from diag group by election_type""",
)
def q_error_by_group(spark, sf):
    return round_doubles(ME.error_by_group(naive_diag(spark, sf)))


def _bin_sql() -> str:
    parts = []
    for lo, hi, lab in zip(ME.BIN_EDGES[:-1], ME.BIN_EDGES[1:], ME.BIN_LABELS):
        parts.append(f"when y_true > {lo} and y_true <= {hi} then '{lab}'")
    lab = "case " + " ".join(parts) + " end"
    return _EV_BASE + f""", b as (select {lab} as bin_part, abs(y_pred - y_true) as abs_error from diag)
 select bin_part, count(*) as n, {O.r6('avg(abs_error)')} as mae, {O.r6('quantile_cont(abs_error, 0.5)')} as medae,
  {O.r6('quantile_cont(abs_error, 0.95)')} as p95, {O.r6('quantile_cont(abs_error, 0.99)')} as p99 from b where bin_part is not null group by bin_part"""


@register("error_by_bin", _bin_sql)
def q_error_by_bin(spark, sf):
    return round_doubles(ME.error_by_bin(naive_diag(spark, sf)))


@register(
    "error_in_zone",
    _EV_BASE + f"""select count(*) as n, {O.r6('avg(abs(y_pred - y_true))')} as mae, {O.r6('quantile_cont(abs(y_pred - y_true), 0.5)')} as medae,
 {O.r6('avg(y_pred - y_true)')} as bias, {O.r6('quantile_cont(abs(y_pred - y_true), 0.95)')} as p95, {O.r6('quantile_cont(abs(y_pred - y_true), 0.99)')} as p99
 from diag where y_true >= 0.12 and y_true <= 0.15""",
)
def q_error_in_zone(spark, sf):
    return round_doubles(ME.error_in_zone(naive_diag(spark, sf)))


@register(
    "residual_quantiles",
    _EV_BASE + "select " + ", ".join(f"{O.r6(f'quantile_cont(y_pred - y_true, {q})')} as q{int(round(q * 100)):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + " from diag",
)
def q_residual_quantiles(spark, sf):
    return round_doubles(ME.residual_quantiles(naive_diag(spark, sf)))


@register(
    "residual_intervals",
    _EV_BASE + "select category, " + ", ".join(f"{O.r6(f'quantile_cont(y_pred - y_true, {q})')} as q{int(round(q * 100)):02d}" for q in (0.05, 0.1, 0.9, 0.95))
    + f", {O.r6('avg(y_pred - y_true)')} as mean, {O.r6('stddev_pop(y_pred - y_true)')} as std, count(*) as n from diag group by category",
)
def q_residual_intervals(spark, sf):
    return round_doubles(ME.residual_intervals(naive_diag(spark, sf)))


EVT = """evt as (select lower(trim(election_type)) || '|' || cast(election_year as varchar) || '|' || cast(round as varchar) as event_key, min(date_scrutin) as date_scrutin
 from diag group by 1),
 evr as (select *, row_number() over (order by date_scrutin, event_key) - 1 as r, count(*) over () as n from evt)"""


@register(
    "event_folds",
    _EV_BASE + ", " + EVT + """, p as (select *, least(4, n - 1) as k, floor(n / (least(4, n - 1) + 1)) as t from evr),
 f as (select p.*, cast(g.fold as integer) as fold from p, range(0, 4) g(fold) where g.fold < p.k),
 o as (select event_key, date_scrutin, fold, case when r < n - (k - fold) * t then 'train' when r < n - (k - fold) * t + t then 'test' end as role from f)
 select * from o where role is not null""",
)
def q_event_folds(spark, sf):
    return FO.event_folds(FO.event_table(naive_diag(spark, sf)), 4)


@register(
    "cut_folds",
    _EV_BASE + ", " + EVT + """, f as (select e.*, cast(g.fold as integer) as fold, least(floor(n * (5 + g.fold) / 10), n - 1) as cut from evr e, range(1, 5) g(fold) where n >= 2),
 o as (select event_key, date_scrutin, fold, case when r < greatest(cut, 0) then 'train' when r = cut then 'test' end as role from f)
 select * from o where role is not null""",
)
def q_cut_folds(spark, sf):
    return FO.cut_folds(FO.event_table(naive_diag(spark, sf)), 4)


@register(
    "row_folds",
    _EV_BASE + """, c as (select election_year, count(*) as rows from diag group by election_year),
 cc as (select *, coalesce(sum(rows) over (order by election_year rows between unbounded preceding and 1 preceding), 0) as before, sum(rows) over () as n from c),
 p as (select *, least(4, n - 1) as k, floor(n / (least(4, n - 1) + 1)) as t from cc),
 f as (select p.*, cast(g.fold as integer) as fold, n - (k - g.fold) * t as st from p, range(0, 4) g(fold) where g.fold < p.k),
 o as (select election_year, fold, 'train' as role, cast(greatest(least(before + rows, st) - before, 0) as bigint) as n_rows from f
  union all select election_year, fold, 'test', cast(greatest(least(before + rows, st + t) - greatest(before, st), 0) as bigint) from f)
 select * from o where n_rows > 0""",
)
def q_row_folds(spark, sf):
    out = FO.row_folds(naive_diag(spark, sf), 4, order_col="election_year")
    return out.withColumn("n_rows", F.col("n_rows").cast("long"))


@register(
    "temporal_split",
    _EV_BASE + """select code_bv, election_type, election_year, round, category,
 case when election_year <= 1997 then 'train' when election_year > 1997 and election_year <= 1999 then 'valid' when election_year >= 2000 then 'test' end as split from diag""",
)
def q_temporal_split(spark, sf):
    return FO.temporal_split(naive_diag(spark, sf), 1997, 1999, 2000).select("code_bv", "election_type", "election_year", "round", "category", "split")


@register(
    "assign_folds",
    _EV_BASE + ", " + EVT + """, p as (select *, least(4, n - 1) as k, floor(n / (least(4, n - 1) + 1)) as t from evr),
 f as (select p.*, cast(g.fold as integer) as fold from p, range(0, 4) g(fold) where g.fold < p.k),
 o as (select event_key, fold, case when r < n - (k - fold) * t then 'train' when r < n - (k - fold) * t + t then 'test' end as role from f)
 select d.code_bv, d.category, o.event_key, o.fold, o.role from diag d
 join o on lower(trim(d.election_type)) || '|' || cast(d.election_year as varchar) || '|' || cast(d.round as varchar) = o.event_key where o.role is not null""",
)
def q_assign_folds(spark, sf):
    d = naive_diag(spark, sf)
    out = FO.assign_folds(d, FO.event_folds(FO.event_table(d), 4))
    return out.select("code_bv", "category", "event_key", "fold", "role")


# ------------------------------------------------------------------ scenario family (all stations at once)
from votepanel.constants import DISPLAY_ORDER  # noqa: E402
from votepanel.operators import scenario as SCN  # noqa: E402

# Scenario parameters. The fixture's election types are order priorities; the blend weights of the
# original's six election types are given to them in the same order.
FIXTURE_BLEND = {"urgent": 0.4, "high": 0.35, "medium": 0.3, "not specified": 0.3, "low": 0.2}
SHARE_FIX = {"centre": 30.0, "extreme_droite": 15.0}
TRANSFERS = [("extreme_droite", "droite_dure", 2.0), ("droite_dure", "centre", 1.5), ("abstention", "gauche_modere", 1.0)]
TARGET_BLOC = "centre"


def forecast_wide(spark, sf):
    return FC.trend_forecast_wide(local_table(spark, sf), TARGET_TYPE, TARGET_YEAR)


def _fc_base(*extra: str) -> str:
    return O.with_ctes(*O.forecast_ctes(TARGET_TYPE, TARGET_YEAR), O.forecast_wide_cte(), *extra)


_SHARES = [f"share_{c}" for c in _CATS]
_COUNTS = [f"count_{c}" for c in DISPLAY_ORDER]


@register("trend_forecast_wide", lambda: _fc_base() + O.select_r6(["code_bv", *_SHARES, *_COUNTS, "inscrits_total", "exprimes_total"], set(_SHARES), "fc_wide"))
def q_trend_forecast_wide(spark, sf):
    return round_doubles(forecast_wide(spark, sf).select("code_bv", *_SHARES, *_COUNTS, "inscrits_total", "exprimes_total"))


def _blend_sql() -> str:
    t = TARGET_TYPE
    wgt = FIXTURE_BLEND[t]
    hist = "bh as (select code_bv, " + ", ".join(
        f"arg_max(share, date_scrutin) filter (where category = '{c}' and share is not null and election_type = '{t}') as h_{c}" for c in _CATS
    ) + f" from fx_rates where election_year < {TARGET_YEAR} group by code_bv)"
    avail = " + ".join(f"(case when h.h_{c} is not null then 1 else 0 end)" for c in _CATS)
    b0 = f"b0 as (select w.code_bv, {', '.join(f'w.share_{c}' for c in _CATS)}, {', '.join(f'h.h_{c}' for c in _CATS)}, {avail} as avail from fc_wide w left join bh h on w.code_bv = h.code_bv)"
    b1 = "b1 as (select *, " + ", ".join(
        f"case when h_{c} is null then share_{c} else (1 - {wgt} * avail / 7) * share_{c} + ({wgt} * avail / 7) * h_{c} end as b_{c}" for c in _CATS
    ) + " from b0)"
    b2 = "b2 as (select *, " + " + ".join(f"b_{c}" for c in _CATS) + " as tot from b1)"
    out = ", ".join(f"{O.r6(f'case when avail = 0 then share_{c} when tot > 0 then b_{c} / tot else b_{c} end')} as share_{c}" for c in _CATS)
    return _fc_base(hist, b0, b1, b2) + f"select code_bv, {out} from b2"


@register("blend_type_history", _blend_sql)
def q_blend_type_history(spark, sf):
    wide = forecast_wide(spark, sf).select("code_bv", *_SHARES)
    hist = SC.score_features(history_table(spark, sf), TARGET_TYPE, TARGET_YEAR).select("code_bv", *[f"prev_share_type_lag1_{c}" for c in _CATS])
    out = SCN.blend_type_history(wide.join(hist, on="code_bv", how="left"), TARGET_TYPE, weights=FIXTURE_BLEND)
    return round_doubles(out.select("code_bv", *_SHARES))


def _overrides_sql() -> str:
    fixed = {c: v / 100.0 for c, v in SHARE_FIX.items()}
    rest = [c for c in DISPLAY_ORDER if c not in fixed]
    remaining = 1.0 - sum(fixed.values())
    base = " + ".join(f"share_{c}" for c in rest)
    cols = []
    for c in _CATS:
        if c in fixed:
            cols.append(f"{O.r6(repr(fixed[c]))} as share_{c}")
        else:
            cols.append(f"{O.r6(f'case when ({base}) <= 0 then {remaining!r} / {len(rest)} else share_{c} / ({base}) * {remaining!r} end')} as share_{c}")
    return _fc_base() + "select code_bv, " + ", ".join(cols) + " from fc_wide"


@register("share_overrides", _overrides_sql)
def q_share_overrides(spark, sf):
    return round_doubles(SCN.share_overrides(forecast_wide(spark, sf).select("code_bv", *_SHARES), SHARE_FIX).select("code_bv", *_SHARES))


_ITEMS = [*DISPLAY_ORDER, "blancs", "nuls", "abstention"]


def _transfer_ctes() -> list[str]:
    ctes = ["tr0 as (select code_bv, inscrits_total, " + ", ".join(f"count_{c} as c_{c}" for c in _ITEMS) + " from fc_wide)"]
    for i, (src, dst, pct) in enumerate(TRANSFERS, start=1):
        delta = f"cast(round_even(inscrits_total * {pct!r} / 100.0, 0) as bigint)"
        moved = f"(case when {delta} > 0 then least(greatest(c_{src}, 0), {delta}) else 0 end)"
        cols = []
        for c in _ITEMS:
            if c == src:
                cols.append(f"case when {delta} > 0 then greatest(c_{c}, 0) - {moved} else c_{c} end as c_{c}")
            elif c == dst:
                cols.append(f"c_{c} + {moved} as c_{c}")
            else:
                cols.append(f"c_{c}")
        ctes.append(f"tr{i} as (select code_bv, inscrits_total, {', '.join(cols)} from tr{i - 1})")
    return ctes


@register(
    "apply_transfers",
    lambda: _fc_base(*_transfer_ctes()) + "select code_bv, " + ", ".join(f"cast(c_{c} as bigint) as count_{c}" for c in _ITEMS) + f" from tr{len(TRANSFERS)}",
)
def q_apply_transfers(spark, sf):
    out = SCN.apply_transfers(forecast_wide(spark, sf), TRANSFERS)
    return out.select("code_bv", *[F.col(f"count_{c}").cast("long").alias(f"count_{c}") for c in _ITEMS])


def _opp_sql(order_limit: str = "") -> str:
    def top(p):
        return f"(list_max([{', '.join(f'{{v: {p}{c}, i: {-i}, c: {chr(39)}{c}{chr(39)}}}' for i, c in enumerate(DISPLAY_ORDER))}])).c"

    n = len(TRANSFERS)
    body = f""", j as (select b.code_bv, {', '.join(f'b.c_{c} as b_{c}' for c in DISPLAY_ORDER)}, {', '.join(f'a.c_{c} as a_{c}' for c in DISPLAY_ORDER)}
  from tr0 b join tr{n} a on b.code_bv = a.code_bv),
 o as (select code_bv as bureau, a_{TARGET_BLOC} - b_{TARGET_BLOC} as gain_cible, b_{TARGET_BLOC} as score_base, a_{TARGET_BLOC} as score_apres,
  {top('b_')} as top_base, {top('a_')} as top_apres from j)
 select *, case when top_base <> '{TARGET_BLOC}' and top_apres = '{TARGET_BLOC}' then 'oui' else 'non' end as bascule from o {order_limit}"""
    return _fc_base(*_transfer_ctes()) + "select * from (with " + body.lstrip(", ") + ") q"


@register("opportunity_table", _opp_sql)
def q_opportunity_table(spark, sf):
    wide = forecast_wide(spark, sf)
    return SCN.opportunity_table(wide, SCN.apply_transfers(wide, TRANSFERS), TARGET_BLOC)


@register("rank_opportunities", lambda: _opp_sql() + " order by bascule desc, gain_cible desc, bureau limit 20")
def q_rank_opportunities(spark, sf):
    wide = forecast_wide(spark, sf)
    # top-k report: the limit is the feature
    return SCN.rank_opportunities(SCN.opportunity_table(wide, SCN.apply_transfers(wide, TRANSFERS), TARGET_BLOC)).limit(20)


@register(
    "prediction_table",
    lambda: _fc_base() + " union all ".join(
        f"select code_bv, {i} as position, '{n}' as categorie, cast({col} as bigint) as nombre from fc_wide"
        for i, (n, col) in enumerate([(c, f"count_{c}") for c in DISPLAY_ORDER] + [("blancs", "blancs_total"), ("nuls", "nuls_total"), ("abstention", "abstention_total")])
    ),
)
def q_prediction_table(spark, sf):
    return SCN.prediction_table(forecast_wide(spark, sf))


@register(
    "map_colour_key",
    lambda: _fc_base() + "select code_bv, case when abs((share_gauche_dure + share_gauche_modere) - (share_droite_dure + share_droite_modere)) <= 0.1 then 'neutral' else "
    + "(list_max([" + ", ".join(f"{{v: share_{c}, i: {-i}, c: '{c}'}}" for i, c in enumerate(DISPLAY_ORDER)) + "])).c end as colour_key from fc_wide",
)
def q_map_colour_key(spark, sf):
    return SCN.map_colour_key(forecast_wide(spark, sf))


def _interval_sql() -> str:
    band = ("q10", "q90")
    res = f"""res as (select category, quantile_cont(y_pred - y_true, 0.1) as q10, quantile_cont(y_pred - y_true, 0.9) as q90 from diag group by category)"""
    rows = "ir as (" + " union all ".join(f"select code_bv, exprimes_total, {i} as position, '{c}' as category, share_{c} as share from fc_wide" for i, c in enumerate(DISPLAY_ORDER)) + ")"
    j = f"""ij as (select r.*, case when s.{band[0]} is not null and s.{band[1]} is not null then s.{band[0]} else -0.03 end as lo,
  case when s.{band[0]} is not null and s.{band[1]} is not null then s.{band[1]} else 0.03 end as hi from ir r left join res s on r.category = s.category),
 ik as (select *, least(greatest(share + lo, 0.0), 1.0) as sl, least(greatest(share + hi, 0.0), 1.0) as sh from ij),
 ic as (select *, cast(round_even(share * exprimes_total, 0) as bigint) as baseline, cast(round_even(sl * exprimes_total, 0) as bigint) as cl,
  cast(round_even(sh * exprimes_total, 0) as bigint) as ch from ik)"""
    sel = f"""select code_bv, position, category, {O.r6('share * 100')} as baseline_pct, {O.r6('case when cl > ch then sh else sl end * 100')} as min_pct,
 {O.r6('case when cl > ch then sl else sh end * 100')} as max_pct, baseline, case when cl > ch then ch else cl end as min, case when cl > ch then cl else ch end as max from ic"""
    return O.with_ctes(*O.forecast_ctes(TARGET_TYPE, TARGET_YEAR), O.forecast_wide_cte(), O.FX_NAT, O.FX_EC, O.FX_LAGS, DIAG, res, rows, j) + sel


@register("interval_table", _interval_sql)
def q_interval_table(spark, sf):
    resid = ME.residual_intervals(naive_diag(spark, sf))
    # report rule of the registry (6 decimals); the 1-decimal display rounding is unit-tested
    return round_doubles(SCN.interval_table(forecast_wide(spark, sf), resid, decimals=None))


# ------------------------------------------------------------------ ingest family (write derived raw files, read them back)
import re  # noqa: E402
from urllib.parse import unquote  # noqa: E402

from votepanel.session import scratch_path  # noqa: E402
from votepanel.sources import delimited as DL  # noqa: E402
from votepanel.sources.tables import fx_long, fx_wide, wide_numbers  # noqa: E402
from votepanel.operators.reshape import unpivot_numbered  # noqa: E402

# Raw-file vocabulary of the derived fixtures (French labels with accents, decimal comma).
RAW_RENAME = {"Inscrits": "inscrits", "Votants": "votants", "Blancs": "blancs", "Nuls": "nuls", "Exprimés": "exprimes",
              "Code Nuance": "code_candidature", "Voix": "voix"}


def _comma(c):
    return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))


def write_raw_results(spark, sf) -> tuple[str, list[str]]:
    """fx_long written as raw result files: one folder per election type, Latin-1, ``;``, decimal comma."""
    lg = fx_long(spark, sf)
    raw = lg.select(
        F.col("type_scrutin"),
        F.col("code_commune").cast("int").cast("string").alias("Code de la commune"),
        F.substring_index("code_bv", "-", -1).cast("int").cast("string").alias("Code B.Vote"),
        F.col("annee").cast("string").alias("Année"),
        F.col("tour").cast("string").alias("N° tour"),
        F.date_format("date_scrutin", "yyyy-MM-dd").alias("Date"),
        *[_comma(c).alias(lab) for lab, c in (("Inscrits", "inscrits"), ("Votants", "votants"), ("Blancs", "blancs"), ("Nuls", "nuls"), ("Exprimés", "exprimes"))],
        F.col("code_candidature").alias("Code Nuance"),
        _comma("voix").alias("Voix"),
    )
    path = scratch_path(spark, "raw_results")
    raw.write.mode("overwrite").partitionBy("type_scrutin").option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return path, written_types(spark, path)


#: Folder name of the rows without a value of the partition column.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def written_types(spark, path: str) -> list[str | None]:
    """Election types of a results folder, from the names of its files (metadata): the votes are not computed again for them."""
    folders = {unquote(f).rsplit("type_scrutin=", 1)[1].split("/", 1)[0] for f in spark.read.schema("value string").text(path).inputFiles()}
    return [None if f == _NO_VALUE else unquote(f) for f in sorted(folders)]


def type_folder(path: str, election_type: str | None) -> str:
    """Folder of a type, with the characters escaped that Spark escapes in partition folders."""
    name = _NO_VALUE if election_type is None else re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", election_type)
    return f"{path}/type_scrutin={name}"


def raw_catalog(path: str, types: list[str]) -> dict:
    entries: dict = {
        "base": {"path": f"{path}/type_scrutin=__none__", "tour_column": "N° tour", "date_column": "Date", "year_column": "Année",
                 "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4], "rename_map": RAW_RENAME},
    }
    for t in types:
        entries[f"results_{t}"] = {"copy_from": "base", "path": type_folder(path, t), "type_scrutin": t}
    entries.pop("base")
    base = {"tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "code_bv_cols": ["Code de la commune", "Code B.Vote"],
            "code_bv_widths": [5, 4], "rename_map": RAW_RENAME}
    return {"base": {**base, "path": path}, **entries}


_STD = ["code_bv", "annee", "date_scrutin", "type_scrutin", "tour", "inscrits", "votants", "blancs", "nuls", "exprimes", "code_candidature", "voix"]


@register("ingest_catalog", O.with_ctes(O.FX_LONG) + "select " + ", ".join(_STD) + " from fx_long")
def q_ingest_catalog(spark, sf):
    path, types = write_raw_results(spark, sf)
    cat = raw_catalog(path, types)
    resolved = DL.resolve_catalog(cat)
    resolved.pop("base")
    return DL.ingest_catalog(spark, resolved).select(*_STD)


@register("read_delimited", O.with_ctes(O.FX_LONG) + "select code_bv, type_scrutin, annee, tour, code_candidature, voix, exprimes from fx_long")
def q_read_delimited(spark, sf):
    path, types = write_raw_results(spark, sf)
    meta = {"path": path, "tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin",
            "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4], "rename_map": RAW_RENAME}
    return DL.standardise_election(spark, meta).select("code_bv", "type_scrutin", "annee", "tour", "code_candidature", "voix", "exprimes")


_RB_SQL = O.with_ctes(O.FX_LONG) + """select code_bv, type_scrutin, annee, tour, cast(rn as integer) as cand_idx, code_candidature, voix from (
 select *, row_number() over (partition by code_bv, type_scrutin, annee, tour order by voix desc, code_candidature) as rn from fx_long) r"""


@register("read_repeated_blocks", _RB_SQL)
def q_read_repeated_blocks(spark, sf):
    w = fx_wide(spark, sf)
    blocks = [F.when(F.col(f"voix_{i}").isNotNull(), F.concat_ws(";", F.col(f"nuance_{i}"), F.col(f"voix_{i}").cast("string"), F.lit("x"))) for i in wide_numbers(w)]
    line = F.concat_ws(";", "code_bv", "type_scrutin", F.col("annee").cast("string"), F.col("tour").cast("string"), F.col("exprimes").cast("string"), *blocks)
    path = scratch_path(spark, "repeated_blocks")
    w.select(line.alias("value")).write.mode("overwrite").text(path)
    long_ = DL.read_repeated_blocks(spark, path, base_width=5, block_width=3, block_fields={"code_candidature": 0, "voix": 1},
                                    base_names=["code_bv", "type_scrutin", "annee", "tour", "exprimes"], skip_header=False)
    return long_.select("code_bv", "type_scrutin", F.col("annee").cast("int").alias("annee"), F.col("tour").cast("int").alias("tour"),
                        "cand_idx", "code_candidature", F.col("voix").try_cast("double").alias("voix"))


@register("unpivot_candidates", _RB_SQL)
def q_unpivot_candidates(spark, sf):
    w = fx_wide(spark, sf)
    idx = {i: {"voix": f"voix_{i}", "code_candidature": f"nuance_{i}"} for i in wide_numbers(w)}
    out = unpivot_numbered(w, ["code_bv", "type_scrutin", "annee", "tour"], idx, positive_only=True)
    return out.select("code_bv", "type_scrutin", "annee", "tour", F.col("cand_idx").cast("int").alias("cand_idx"), "code_candidature", "voix")


@register(
    "read_mapping",
    O.with_ctes(O.FX_MAP) + """select upper(code_candidature) as code_candidature, max(case when k = 0 then category end) as bloc_1,
 max(case when k = 1 then category end) as bloc_2, max(case when k = 2 then category end) as bloc_3 from fx_map group by code_candidature""",
)
def q_read_mapping(spark, sf):
    m = fx_mapping(spark, sf)
    # ragged lines: trailing empty blocs are left out, as in the shipped mapping file
    line = F.concat_ws(";", "code_candidature", "nom_candidature", "bloc_1", "bloc_2", "bloc_3")
    path = scratch_path(spark, "mapping")
    header = spark.createDataFrame([("code_candidature;nom_candidature;bloc_1;bloc_2;bloc_3", 0)], "value string, k int")
    lines = header.unionByName(m.select(line.alias("value"), F.lit(1).alias("k")))
    # one small file (the mapping has one row per party code), header line first
    lines.repartition(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
    back = normalise_mapping(DL.read_mapping(spark, path))
    return back.select("code_candidature", "bloc_1", "bloc_2", "bloc_3")


@register("read_long_table", O.with_ctes(O.FX_LONG) + "select " + ", ".join(_STD) + " from fx_long where code_commune = '00003'")
def q_read_long_table(spark, sf):
    path = scratch_path(spark, "long")
    DL.write_dual(fx_long(spark, sf), path, partition_by=("annee",))
    return DL.read_long_table(spark, f"{path}/parquet", commune_code="00003").select(*_STD)


@register("write_dual", O.with_ctes(O.FX_LONG) + "select code_bv, annee, type_scrutin, tour, code_candidature, voix, exprimes from fx_long")
def q_write_dual(spark, sf):
    path = scratch_path(spark, "dual")
    DL.write_dual(fx_long(spark, sf), path, partition_by=("annee",))
    back = spark.read.option("sep", ";").option("header", True).csv(f"{path}/csv")
    return back.select("code_bv", F.col("annee").cast("int").alias("annee"), "type_scrutin", F.col("tour").cast("int").alias("tour"),
                       "code_candidature", F.col("voix").cast("double").alias("voix"), F.col("exprimes").cast("double").alias("exprimes"))


# ------------------------------------------------------------------ warehouse family (star schema on Parquet)
from votepanel.plans import warehouse as WH  # noqa: E402
from votepanel.plans.queries_core import q_build_panel  # noqa: E402


def _pn() -> str:
    return f"pn as ({O.panel_sql()})"


def _melt_sql() -> str:
    idx = "commune_code, code_bv, election_type, election_year, round, date_scrutin, turnout_pct"
    return " union all ".join(f"select {idx}, '{c}' as category, target_share_{c} as share from pn" for c in _CATS)


PN_LONG = lambda: f"pl as ({_melt_sql()})"


@register("melt_panel", lambda: O.with_ctes(_pn()) + _melt_sql())
def q_melt_panel(spark, sf):
    return WH.melt_panel(q_build_panel(spark, sf))


_DIMS_SQL = """tw as (select commune_code, cast(dense_rank() over (order by commune_code) as integer) as commune_id from (select distinct commune_code from pl) t),
 bu as (select commune_id, bureau_code, cast(dense_rank() over (order by commune_id, bureau_code) as integer) as bureau_id from (
   select distinct t.commune_id, regexp_replace(p.code_bv, '^[^-]*-', '') as bureau_code from pl p join tw t on p.commune_code = t.commune_code) b),
 el as (select election_type, election_year, round, min(date_scrutin) as date, cast(dense_rank() over (order by election_type, election_year, round) as integer) as election_id
   from pl group by election_type, election_year, round),
 ca as (select * from (values """ + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(["centre", "gauche_modere", "droite_modere", "gauche_dure", "droite_dure", "extreme_gauche", "extreme_droite"])) + """) v(category_id, category)),
 lk as (select p.*, t.commune_id, b.bureau_id, e.election_id, c.category_id from pl p join tw t on p.commune_code = t.commune_code
   join bu b on b.commune_id = t.commune_id and b.bureau_code = regexp_replace(p.code_bv, '^[^-]*-', '')
   join el e on e.election_type = p.election_type and e.election_year = p.election_year and e.round = p.round join ca c on c.category = p.category)"""


def _star(spark, sf):
    lp = WH.melt_panel(q_build_panel(spark, sf))
    dims = WH.star_dimensions(lp)
    return lp, dims


@register(
    "key_lookup",
    lambda: O.with_ctes(_pn(), PN_LONG(), _DIMS_SQL) + "select code_bv, election_type, election_year, round, category, commune_id, bureau_id, election_id, category_id from lk",
)
def q_key_lookup(spark, sf):
    lp, dims = _star(spark, sf)
    return WH.key_lookup(lp, dims).select("code_bv", "election_type", "election_year", "round", "category", "commune_id", "bureau_id", "election_id", "category_id")


@register(
    "star_schema",
    lambda: O.with_ctes(_pn(), PN_LONG(), _DIMS_SQL) + f"""select 'categories' as table_name, category_id as id, category as label, cast(null as double) as share_pct from ca
 union all select 'communes', commune_id, commune_code, null from tw
 union all select 'bureaux', bureau_id, concat(commune_id, '|', bureau_code), null from bu
 union all select 'elections', election_id, concat(election_type, '|', election_year, '|', round), null from el
 union all select 'results_local', bureau_id, concat(election_id, '|', category_id), {O.r6('round_even(share * 100, 6)')} from lk
 union all select 'results_national', election_id, cast(category_id as varchar), {O.r6('sum(cast(round(round_even(share * 100, 6) * 1000000) as bigint)) / count(share) / 1000000.0')} from lk group by election_id, category_id""",
)
def q_star_schema(spark, sf):
    """The rows of all six tables as they are read back: table, id, natural key, share."""
    lp, dims = _star(spark, sf)
    paths = WH.write_star({**dims, **WH.star_facts(lp, dims)}, scratch_path(spark, "star"))
    shown = {"categories": ("id", ["name"]), "communes": ("id", ["insee_code"]), "bureaux": ("id", ["commune_id", "bureau_code"]),
             "elections": ("id", ["election_type", "election_year", "round"]), "results_local": ("bureau_id", ["election_id", "category_id"]),
             "results_national": ("election_id", ["category_id"])}
    from functools import reduce as _reduce

    def rows(name):
        t, (key, label) = spark.read.parquet(paths[name]), shown[name]
        share = F.col("share_pct") if "share_pct" in t.columns else F.lit(None).cast("double")
        return t.select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.concat_ws("|", *label).alias("label"), share.alias("share_pct"))

    return round_doubles(_reduce(lambda a, b: a.unionByName(b), [rows(n) for n in shown]))


@register(
    "history_star_join",
    lambda: O.with_ctes(_pn(), PN_LONG(), _DIMS_SQL) + f""", nat as (select election_id, category_id, sum(cast(round(round_even(share * 100, 6) * 1000000) as bigint)) / count(share) / 1000000.0 as share_nat_pct from lk group by election_id, category_id)
 select l.commune_code, l.code_bv, l.election_type, l.election_year, l.round, l.date_scrutin, l.category, {O.r6('round_even(l.share * 100, 6) / 100')} as share,
  {O.r6('n.share_nat_pct / 100')} as share_nat, {O.r6('l.turnout_pct * 100 / 100')} as turnout_pct
 from lk l left join nat n on l.election_id = n.election_id and l.category_id = n.category_id where l.commune_code = (select min(commune_code) from pl)""",
)
def q_history_star_join(spark, sf):
    lp, dims = _star(spark, sf)
    paths = WH.write_star({**dims, **WH.star_facts(lp, dims)}, scratch_path(spark, "star"))
    town = lp.agg(F.min("commune_code")).first()[0]
    return round_doubles(WH.history_star_join(spark, paths, town))


def _national_versions(spark, sf):
    loc = local_table(spark, sf)
    old = ST.star_national(loc.where(F.col("election_year") <= 1999))
    new = ST.star_national(loc.where(F.col("election_year") >= 1999)).withColumn("share", F.col("share") + F.lit(0.001))
    return old, new


_UPS_SQL = O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES) + """, old as (select election_type, election_year, round, category, avg(share) as share, avg(turnout_pct) as turnout
  from fx_rates where election_year <= 1999 group by all),
 new as (select election_type, election_year, round, category, avg(share) + 0.001 as share, avg(turnout_pct) as turnout from fx_rates where election_year >= 1999 group by all)"""
_UKEYS = ["election_type", "election_year", "round", "category"]


def _merged_versions(spark, sf, update: bool):
    """The national table up to 1999, written in partitions by year, and the rows from 1999 merged into it."""
    old, new = _national_versions(spark, sf)
    path, part = scratch_path(spark, "national"), WH.key_range("election_year", 1)
    WH.create_merge_table(old, path, part)
    return round_doubles(WH.merge_table(spark, path, new, _UKEYS, part, update=update))


@register(
    "upsert_ignore",
    _UPS_SQL + f""" select election_type, election_year, round, category, {O.r6('share')} as share, {O.r6('turnout')} as turnout from (
  select * from old union all select * from new n where not exists (select 1 from old o where o.election_type = n.election_type and o.election_year = n.election_year
   and o.round = n.round and o.category = n.category)) u""",
)
def q_upsert_ignore(spark, sf):
    return _merged_versions(spark, sf, False)


@register(
    "upsert_update",
    _UPS_SQL + f""" select election_type, election_year, round, category, {O.r6('share')} as share, {O.r6('turnout')} as turnout from (
  select * from new union all select * from old o where not exists (select 1 from new n where o.election_type = n.election_type and o.election_year = n.election_year
   and o.round = n.round and o.category = n.category)) u""",
)
def q_upsert_update(spark, sf):
    return _merged_versions(spark, sf, True)


@register("load_flat_table", lambda: O.with_ctes(*O.fb_ctes(BASE_YEAR)) + O.select_r6(_BLOCS, _BLOCS_DBL, "fb_lags"))
def q_load_flat_table(spark, sf):
    loaded = WH.load_flat_table(blocs_table(spark, sf), scratch_path(spark, "elections_blocs"))
    return round_doubles(loaded.select(*_BLOCS))


# ------------------------------------------------------------------ streaming ingest (file stream -> long table)
@register("stream_ingest", O.with_ctes(O.FX_LONG) + "select " + ", ".join(_STD) + " from fx_long")
def q_stream_ingest(spark, sf):
    from votepanel.streaming.ingest import start_results_stream

    path, types = write_raw_results(spark, sf)
    cols = ["Code de la commune", "Code B.Vote", "Année", "N° tour", "Date", "Inscrits", "Votants", "Blancs", "Nuls", "Exprimés", "Code Nuance", "Voix"]
    sink = scratch_path(spark, "stream_sink")
    meta = {"tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin",
            "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4], "rename_map": RAW_RENAME}
    # the results folder is partitioned by type: the stream reads each type folder as its own source, and all of them run at once
    streams = [start_results_stream(spark, type_folder(path, t), cols, f"{sink}/{i}", {**meta, "type_scrutin": t, "type_column": None},
                                    checkpoint_location=scratch_path(spark, "stream_ckpt")) for i, t in enumerate(types)]
    try:
        for q in streams:
            q.awaitTermination()
    finally:
        for q in streams:
            q.stop()
    from functools import reduce as _reduce

    parts = [spark.read.parquet(f"{sink}/{i}").select(*_STD) for i in range(len(types))]
    return _reduce(lambda a, b: a.unionByName(b), parts)
