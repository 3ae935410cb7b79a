"""DuckDB/ANSI SQL texts used as independent oracles of the registered queries.

Only the driver's base tables are registered on the oracle side, so the election views are inlined as
CTEs. Doubles are reported with ``floor(x*1000000+0.5)/1000000`` in both engines (``round`` differs on
decimal ties between engines).
"""

from __future__ import annotations

from votepanel.constants import CATEGORIES, INDEX_COLS, PANEL_FEATURES

FX_LONG = """fx_long as (
 with base as (
  select lpad(cast(s.s_nationkey as varchar),5,'0') as code_commune,
   concat(lpad(cast(s.s_nationkey as varchar),5,'0'),'-',lpad(cast(l.l_suppkey as varchar),4,'0')) as code_bv,
   lower(substr(o.o_orderpriority,3)) as type_scrutin, cast(year(o.o_orderdate) as int) as annee,
   case when o.o_orderstatus='O' then 2 else 1 end as tour,
   make_date(cast(year(o.o_orderdate) as int), 2*cast(substr(o.o_orderpriority,1,1) as int),
             case when o.o_orderstatus='O' then 14 else 7 end) as date_scrutin,
   p.p_brand as code_candidature, l.l_quantity as q, l.l_returnflag as rf
  from lineitem l join orders o on l.l_orderkey=o.o_orderkey
  join supplier s on l.l_suppkey=s.s_suppkey join part p on l.l_partkey=p.p_partkey),
 tot as (select code_bv,type_scrutin,annee,tour,sum(q) as exprimes,
   cast(sum(case when rf='R' then 1 else 0 end) as double) as blancs,
   cast(sum(case when rf='A' then 1 else 0 end) as double) as nuls, cast(count(*) as double) as n
   from base group by code_bv,type_scrutin,annee,tour)
 select b.code_commune,b.code_bv,b.type_scrutin,b.annee,b.tour,b.date_scrutin,b.code_candidature,sum(b.q) as voix,
  max(t.exprimes) as exprimes,max(t.blancs) as blancs,max(t.nuls) as nuls,max(t.exprimes+t.blancs+t.nuls) as votants,
  max(t.exprimes+t.blancs+t.nuls+10*t.n) as inscrits
 from base b join tot t on b.code_bv=t.code_bv and b.type_scrutin=t.type_scrutin and b.annee=t.annee and b.tour=t.tour
 group by b.code_commune,b.code_bv,b.type_scrutin,b.annee,b.tour,b.date_scrutin,b.code_candidature)"""

FX_MAP = """fx_map as (
 select * from (
  select concat('Brand#',cast(n as varchar)) as code_candidature,
   case (n + k) % 7 when 0 then 'centre' when 1 then 'gauche_modere' when 2 then 'droite_modere' when 3 then 'gauche_dure'
        when 4 then 'droite_dure' when 5 then 'extreme_gauche' else 'extreme_droite' end as category,
   case when n % 6 = 0 then 3 when n % 3 = 0 then 2 else 1 end as n_blocs, k
  from (select distinct cast(substr(p_brand,7) as int) as n from part where p_brand <> 'Brand#25') b
  cross join (values (0),(1),(2)) v(k)) m
 where k < n_blocs)"""

FX_DIRTY = """fx_dirty as (
 select code_commune,code_bv,type_scrutin,annee,tour,date_scrutin,
  case when k%7=0 then concat(' ',lower(code_candidature),' ') when k%11=0 then 'nan' when k%13=0 then '' else code_candidature end as code_candidature,
  case when k%17=0 then null else voix end as voix,
  case when e%5=0 then null else exprimes end as exprimes, blancs, nuls, votants,
  case when e%19=0 then 0.0 else inscrits end as inscrits
 from (select *, cast(substr(code_candidature,7) as int)*31+annee*7+cast(right(code_bv,4) as int) as k,
              annee*3+tour+cast(right(code_bv,4) as int) as e from fx_long) x)"""

# event-category table with the project's column names (expand + aggregate + reference), exact sixths
FX_LOCAL = """fx_local as (
 select l.code_commune as commune_code, l.code_bv, l.type_scrutin as election_type, l.annee as election_year,
  l.tour as round, l.date_scrutin, coalesce(m.category,'centre') as category,
  coalesce(sum(l.voix*cast(6/coalesce(m.n_blocs,1) as int)),0)/cast(6 as double) as voix_cat,
  coalesce(sum(l.voix*cast(6/coalesce(m.n_blocs,1) as int)),0) as voix_sixths,
  max(l.exprimes) as exprimes, max(l.votants) as votants, max(l.inscrits) as inscrits,
  max(l.blancs) as blancs, max(l.nuls) as nuls
 from fx_long l left join fx_map m on l.code_candidature=m.code_candidature
 group by l.code_commune,l.code_bv,l.type_scrutin,l.annee,l.tour,l.date_scrutin,coalesce(m.category,'centre'))"""

FX_LOCAL_RATES = """fx_rates as (
 select *, voix_cat/nullif(exprimes,0) as share, votants/nullif(inscrits,0) as turnout_pct,
  blancs/nullif(inscrits,0) as blancs_pct, nuls/nullif(inscrits,0) as nuls_pct from fx_local)"""

FX_NAT = """fx_nat as (
 select election_type, election_year, round, category,
  (sum(voix_sixths)/cast(6 as double))/nullif(sum(exprimes),0) as share_nat,
  sum(votants)/nullif(sum(inscrits),0) as turnout_nat
 from fx_rates group by election_type, election_year, round, category)"""

FX_EC = """fx_ec as (
 select r.*, n.share_nat, n.turnout_nat from fx_rates r left join fx_nat n
 on r.election_type=n.election_type and r.election_year=n.election_year and r.round=n.round and r.category=n.category)"""

ORDER = "order by date_scrutin, election_type, round"

FX_LAGS = f"""fx_lags as (
 select *, share_lag_any - share_lag2_any as swing_any from (
 select *, share - share_nat as dev_to_nat,
  lag(share,1) over (partition by code_bv, category {ORDER}) as share_lag_any,
  lag(share,2) over (partition by code_bv, category {ORDER}) as share_lag2_any,
  lag(share,1) over (partition by code_bv, category, election_type {ORDER}) as share_lag_same_type,
  lag(share - share_nat,1) over (partition by code_bv, category {ORDER}) as dev_to_nat_lag_any,
  lag(share - share_nat,1) over (partition by code_bv, category, election_type {ORDER}) as dev_to_nat_lag_same_type
 from fx_ec) z)"""


def r6(expr: str) -> str:
    return f"floor(({expr})*1000000+0.5)/1000000"


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def panel_ctes() -> list[str]:
    """CTEs of the panel up to ``fx_norm`` (targets ``n_{category}``, features under their own names, unrounded)."""
    idx = ", ".join(INDEX_COLS)
    piv = []
    for prefix, value in PANEL_FEATURES:
        for c in CATEGORIES:
            piv.append(f"avg(case when category='{c}' then {value} end) as {prefix}{c}")
    wide = f"""fx_wide_panel as (
 select {idx}, {', '.join(piv)}, max(turnout_pct) as turnout_pct, count(share) as n_share
 from fx_lags group by {idx})"""
    tl = f"""fx_tl as (
 select *, lag(turnout_pct,1) over (partition by code_bv {ORDER}) as prev_turnout_any_lag1,
  lag(turnout_pct,1) over (partition by code_bv, election_type {ORDER}) as prev_turnout_same_type_lag1
 from fx_wide_panel)"""
    clipped = {c: f"least(greatest(coalesce(target_share_{c},0.0),0.0),1.0)" for c in CATEGORIES}
    before = " + ".join(clipped[c] for c in CATEGORIES)
    clip_cte = f"""fx_clip as (
 select *, {', '.join(f'{clipped[c]} as t_{c}' for c in CATEGORIES)}, {before} as target_sum_before_renorm
 from fx_tl where n_share > 0)"""
    renorm = {c: f"case when target_sum_before_renorm > 0 then t_{c}/target_sum_before_renorm else t_{c} end" for c in CATEGORIES}
    norm_cte = f"""fx_norm as (
 select *, {', '.join(f'{renorm[c]} as n_{c}' for c in CATEGORIES)} from fx_clip)"""
    return [FX_LONG, FX_MAP, FX_LOCAL, FX_LOCAL_RATES, FX_NAT, FX_EC, FX_LAGS, wide, tl, clip_cte, norm_cte]


def panel_sql() -> str:
    after = " + ".join(f"n_{c}" for c in CATEGORIES)
    cols = [*INDEX_COLS]
    for c in CATEGORIES:
        cols.append(f"{r6(f'n_{c}')} as target_share_{c}")
    for prefix, _ in PANEL_FEATURES[1:]:
        for c in CATEGORIES:
            cols.append(f"{r6(prefix + c)} as {prefix}{c}")
    cols += [
        f"{r6('turnout_pct')} as turnout_pct",
        f"{r6('prev_turnout_any_lag1')} as prev_turnout_any_lag1",
        f"{r6('prev_turnout_same_type_lag1')} as prev_turnout_same_type_lag1",
        f"{r6('target_sum_before_renorm')} as target_sum_before_renorm",
        f"{r6(after)} as target_sum_after_renorm",
    ]
    return with_ctes(*panel_ctes()) + "select " + ",\n ".join(cols) + " from fx_norm"


# ---------------------------------------------------------------- forecast (trend_forecast family)

def _trend_sql(value: str, keep: str, sfx: str, prefix: str = "") -> list[str]:
    valid = f"({keep}) and {value} is not null and election_year is not null"
    v = f"case when {valid} then {value} end"
    x = f"case when {valid} then cast(election_year as double) end"
    return [
        f"count({v}) as {prefix}n{sfx}",
        f"count(distinct {x}) as {prefix}ny{sfx}",
        f"regr_slope({v}, {x}) as {prefix}slope{sfx}",
        f"avg({x}) as {prefix}mx{sfx}",
        f"avg({v}) as {prefix}my{sfx}",
        f"arg_max({value}, date_scrutin) filter (where {valid}) as {prefix}last{sfx}",
        f"min({v}) as {prefix}min{sfx}",
        f"max({v}) as {prefix}max{sfx}",
    ]


def _line_sql(p, target_year: int, min_points: int) -> str:
    return (
        f"case when {p('n')} = 0 then null when {p('n')} >= {min_points} and {p('ny')} >= {min_points} and {p('slope')} is not null "
        f"then {p('my')} + {p('slope')} * ({float(target_year)} - {p('mx')}) else {p('last')} end"
    )


def clip01_sql(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


def forecast_history_ctes(target_year: int) -> list[str]:
    hist = f"""fc_hist0 as (
 select code_bv, election_type, election_year, round, date_scrutin, category, voix_cat, votants, inscrits, blancs, nuls, share,
  case when exprimes is null or exprimes = 0 then sum(voix_cat) over (partition by code_bv, date_scrutin) else exprimes end as exprimes
 from fx_rates where election_year < {target_year})"""
    hist2 = """fc_hist as (
 select * replace (least(case when max(case when share is not null then 1 else 0 end) over (partition by code_bv) = 1 then share
   else voix_cat / nullif(exprimes, 0) end, 1.0) as share) from fc_hist0)"""
    return [hist, hist2]


def project_shares_sql(target_type: str, target_year: int) -> str:
    t = f"election_type = '{target_type}'"
    cols = [
        f"max(case when {t} then 1 else 0 end) as has_t",
        "arg_max(share, date_scrutin) filter (where share is not null) as last_overall",
        *_trend_sql("share", t, "_t"),
        *_trend_sql("share", "true", "_a"),
    ]
    stats = f"fc_sh_stats as (select code_bv, category, {', '.join(cols)} from fc_hist group by code_bv, category)"

    def p(name):
        return f"(case when has_t = 1 then {name}_t else {name}_a end)"

    proj = clip01_sql(_line_sql(p, target_year, 2))
    shares = f"fc_shares as (select code_bv, category, {clip01_sql(f'coalesce({proj}, last_overall, 0.0)')} as raw_share from fc_sh_stats)"
    return stats + ",\n" + shares


def project_rates_sql(target_type: str, target_year: int) -> str:
    ev = """fc_events as (
 select code_bv, date_scrutin, election_type, round, election_year, max(inscrits) as inscrits, max(votants) as votants,
  max(blancs) as blancs, max(nuls) as nuls
 from fc_hist group by code_bv, date_scrutin, election_type, round, election_year)"""
    evr = """fc_ev as (select *, votants/nullif(inscrits,0) as taux_participation, blancs/nullif(inscrits,0) as taux_blancs,
  nuls/nullif(inscrits,0) as taux_nuls from fc_events)"""
    t = f"election_type = '{target_type}'"
    scopes = {"_r1t": f"round = 1 and {t}", "_r1": "round = 1", "_t": t, "_a": "true"}
    cols = [
        "max(case when round = 1 then 1 else 0 end) as has_r1",
        f"max(case when round = 1 and {t} then 1 else 0 end) as has_r1_t",
        f"max(case when {t} then 1 else 0 end) as has_t",
        "arg_max(inscrits, date_scrutin) filter (where inscrits is not null) as last_inscrits",
    ]
    rates = ("taux_participation", "taux_blancs", "taux_nuls")
    for r in rates:
        for sfx, keep in scopes.items():
            cols += _trend_sql(r, keep, sfx, prefix=r)
    stats = f"fc_rate_stats as (select code_bv, {', '.join(cols)} from fc_ev group by code_bv)"
    outs = []
    for r in rates:
        def p(name, r=r):
            return (
                f"(case when has_r1 = 1 then (case when has_r1_t = 1 then {r}{name}_r1t else {r}{name}_r1 end) "
                f"else (case when has_t = 1 then {r}{name}_t else {r}{name}_a end) end)"
            )

        val = f"least(greatest({_line_sql(p, target_year, 3)}, {p('min')}), {p('max')})"
        outs.append(f"{clip01_sql(val)} as {r}")
    rates_cte = f"fc_rates as (select code_bv, last_inscrits, {', '.join(outs)} from fc_rate_stats)"
    return ",\n".join([ev, evr, stats, rates_cte])


HEAD_COUNTS_SQL = """fc_hc0 as (
 select *, cast(round_even(last_inscrits, 0) as bigint) as inscrits_total,
  coalesce(taux_participation, 0.0) as p0, coalesce(taux_blancs, 0.0) as b0, coalesce(taux_nuls, 0.0) as n0 from fc_rates),
fc_hc1 as (
 select *, case when b0 + n0 > p0 and b0 + n0 > 0 then b0 * (p0 / (b0 + n0)) else b0 end as b1,
  case when b0 + n0 > p0 and b0 + n0 > 0 then n0 * (p0 / (b0 + n0)) else n0 end as n1 from fc_hc0),
fc_hc2 as (
 select *, cast(round_even(inscrits_total * p0, 0) as bigint) as votants_total,
  cast(round_even(inscrits_total * b1, 0) as bigint) as bt, cast(round_even(inscrits_total * n1, 0) as bigint) as nt from fc_hc1),
fc_hc3 as (
 select *, case when bt + nt > votants_total and bt + nt > 0 then cast(round_even(bt * (votants_total / cast(bt + nt as double)), 0) as bigint) else bt end as blancs_total,
  case when bt + nt > votants_total and bt + nt > 0 then cast(round_even(nt * (votants_total / cast(bt + nt as double)), 0) as bigint) else nt end as nuls_total
 from fc_hc2),
fc_counts as (
 select *, greatest(votants_total - blancs_total - nuls_total, 0) as exprimes_total,
  greatest(inscrits_total - votants_total, 0) as abstention_total from fc_hc3 where inscrits_total is not null)"""


def display_values_sql() -> str:
    from votepanel.constants import DISPLAY_ORDER

    return ", ".join(f"({i}, '{c}')" for i, c in enumerate(DISPLAY_ORDER))


def forecast_ctes(target_type: str, target_year: int) -> list[str]:
    rows = f"""fc_rows as (
 select s.code_bv, d.position, d.categorie, coalesce(sh.raw_share, 0.0) as raw_share
 from (select distinct code_bv from fc_shares) s cross join (values {display_values_sql()}) d(position, categorie)
 left join fc_shares sh on sh.code_bv = s.code_bv and sh.category = d.categorie),
fc_pred as (
 select *, case when sum(raw_share) over (partition by code_bv) > 0 then raw_share / sum(raw_share) over (partition by code_bv) else 0.0 end as predicted_share
 from fc_rows),
fc_alloc0 as (
 select p.*, c.exprimes_total, greatest(coalesce(p.predicted_share, 0.0), 0.0) as s0 from fc_pred p join fc_counts c on p.code_bv = c.code_bv),
fc_alloc1 as (
 select *, sum(s0) over (partition by code_bv) as ssum from fc_alloc0),
fc_alloc2 as (
 select *, case when exprimes_total > 0 and ssum > 0 then s0 / ssum * exprimes_total else 0.0 end as raw from fc_alloc1),
fc_alloc3 as (
 select *, floor(raw) as fl from fc_alloc2),
fc_alloc4 as (
 select *, case when exprimes_total > 0 and ssum > 0 then exprimes_total - sum(fl) over (partition by code_bv) else 0 end as rem,
  row_number() over (partition by code_bv order by raw - fl desc, position asc) as rk from fc_alloc3),
fc_alloc as (select *, cast(fl + case when rk <= rem then 1 else 0 end as bigint) as nombre from fc_alloc4)"""
    return [FX_LONG, FX_MAP, FX_LOCAL, FX_LOCAL_RATES, *forecast_history_ctes(target_year), project_shares_sql(target_type, target_year),
            project_rates_sql(target_type, target_year), HEAD_COUNTS_SQL, rows]


def forecast_wide_cte() -> str:
    from votepanel.constants import DISPLAY_ORDER

    cols = ", ".join(f"max(case when categorie = '{c}' then predicted_share end) as share_{c}, max(case when categorie = '{c}' then nombre end) as count_{c}" for c in DISPLAY_ORDER)
    return f"""fc_wide as (select w.*, c.inscrits_total, c.votants_total, c.blancs_total, c.nuls_total, c.exprimes_total, c.abstention_total,
  c.blancs_total as count_blancs, c.nuls_total as count_nuls, c.abstention_total as count_abstention
 from (select code_bv, {cols} from fc_alloc group by code_bv) w join fc_counts c on w.code_bv = c.code_bv)"""


def trend_forecast_sql(target_type: str, target_year: int, *, report: bool = True) -> str:
    from votepanel.constants import DISPLAY_ORDER

    n = len(DISPLAY_ORDER)
    ps = r6("predicted_share") if report else "predicted_share"
    final = f"""select code_bv, categorie, position, {ps} as predicted_share, nombre from fc_alloc
union all
select code_bv, 'blancs', {n}, null, blancs_total from fc_counts
union all
select code_bv, 'nuls', {n + 1}, null, nuls_total from fc_counts
union all
select code_bv, 'abstention', {n + 2}, null, abstention_total from fc_counts"""
    return with_ctes(*forecast_ctes(target_type, target_year)) + final


# ---------------------------------------------------------------- elections_blocs family
FB_TOWNS = """fb_towns as (
 select lpad(cast(n.n_nationkey as varchar),5,'0') as code_commune, n.n_name as nom_commune
 from nation n join region r on n.n_regionkey = r.r_regionkey where r.r_name = 'EUROPE')"""

FB_ALL_TOWNS = """fb_towns as (
 select lpad(cast(n_nationkey as varchar),5,'0') as code_commune, n_name as nom_commune from nation)"""

FB_EX = """fb_ex as (
 select l.code_bv, l.date_scrutin, l.annee, l.type_scrutin, l.tour, coalesce(m.category,'centre') as bloc,
  coalesce(l.voix,0.0)/coalesce(m.n_blocs,1) as voix_bloc, l.exprimes, l.inscrits, l.votants, l.blancs, l.nuls
 from fx_long l left join fx_map m on l.code_candidature = m.code_candidature)"""

FB_EV = """fb_ev as (
 select *, voix_bloc/nullif(exprimes,0) as part_bloc, votants/nullif(inscrits,0) as taux_participation_bv,
  blancs/nullif(inscrits,0) as taux_blancs_bv, nuls/nullif(inscrits,0) as taux_nuls_bv
 from (select code_bv, date_scrutin, annee, type_scrutin, tour, bloc, sum(voix_bloc) as voix_bloc, max(exprimes) as exprimes,
  max(inscrits) as inscrits, max(votants) as votants, max(blancs) as blancs, max(nuls) as nuls
  from fb_ex group by code_bv, date_scrutin, annee, type_scrutin, tour, bloc) g)"""

FB_NAT = """fb_nat as (
 select date_scrutin, bloc, sum(voix_bloc)/nullif(sum(exprimes),0) as part_bloc_national,
  sum(votants)/nullif(sum(inscrits),0) as taux_participation_national
 from fb_ev group by date_scrutin, bloc)"""

FB_ATT = """fb_att as (
 select e.*, n.part_bloc_national, n.taux_participation_national,
  e.part_bloc - n.part_bloc_national as ecart_bloc_vs_national,
  e.taux_participation_bv - n.taux_participation_national as ecart_participation_vs_nat
 from fb_ev e left join fb_nat n on e.date_scrutin = n.date_scrutin and e.bloc = n.bloc)"""

FB_TGT = """fb_tgt as (
 select a.*, t.code_commune, t.nom_commune from fb_att a
 join fb_towns t on substr(lpad(regexp_replace(split_part(a.code_bv,'-',1), '[^0-9]', '', 'g'),5,'0'),1,5) = t.code_commune)"""


def fb_growth(base_year: int) -> str:
    return f"""fb_growth as (
 select *, (ins_year - ins_base)/nullif(ins_base,0) as croissance_inscrits_depuis_base from (
  select *, max(case when annee = {base_year} then ins_year end) over (partition by code_bv) as ins_base from (
   select *, avg(inscrits) over (partition by code_bv, annee) as ins_year from fb_tgt) a) b)"""


FB_LAGS = """fb_lags as (
 select *, lag(part_bloc,1) over w as part_bloc_lag1, lag(ecart_bloc_vs_national,1) over w as ecart_bloc_vs_national_lag1,
  lag(taux_participation_bv,1) over w as taux_participation_bv_lag1,
  annee - (select quantile_cont(annee, 0.5) from fb_growth) as annee_centre
 from fb_growth window w as (partition by code_bv, bloc order by date_scrutin, type_scrutin, tour))"""


def fb_ctes(base_year: int = 1995, towns: str = FB_ALL_TOWNS) -> list[str]:
    """The bloc table; ``towns``: all of them, or the target towns where that filter is the feature."""
    return [FX_LONG, FX_MAP, towns, FB_EX, FB_EV, FB_NAT, FB_ATT, FB_TGT, fb_growth(base_year), FB_LAGS]


def select_r6(cols: list[str], doubles: set[str], src: str) -> str:
    return "select " + ", ".join(f"{r6(c)} as {c}" if c in doubles else c for c in cols) + f" from {src}"


# ---------------------------------------------------------------- model table family
def model_table_sql_ctes(base_year: int = 1995) -> list[str]:
    from votepanel.plans.model_table import LAG_STEPS, ROLL_WINDOWS

    base = """mt_base as (
 select * replace (coalesce(tour, 1) as tour, lower(coalesce(type_scrutin, 'inconnu')) as type_scrutin),
  cast(annee = 2020 as int) as is_2020
 from fb_lags where coalesce(tour, 1) = 1 or lower(coalesce(type_scrutin, 'inconnu')) = 'europeennes')"""
    cal = """mt_cal as (
 select *, sin(2*pi()*month/12) as month_sin, cos(2*pi()*month/12) as month_cos, sin(2*pi()*dow/7) as dow_sin, cos(2*pi()*dow/7) as dow_cos
 from (select *, cast(month(date_scrutin) as integer) as month, cast(isodow(date_scrutin) - 1 as integer) as dow from mt_base) c)"""
    cols = []
    for k in LAG_STEPS:
        cols += [f"lag(part_bloc,{k}) over w as part_bloc_lag{k}", f"lag(taux_participation_bv,{k}) over w as taux_participation_bv_lag{k}",
                 f"lag(ecart_bloc_vs_national,{k}) over w as ecart_bloc_vs_national_lag{k}"]
    for n in ROLL_WINDOWS:
        fr = f"(w rows between {n} preceding and 1 preceding)"
        cols += [f"avg(part_bloc) over {fr} as part_bloc_roll_mean_{n}", f"stddev_samp(part_bloc) over {fr} as part_bloc_roll_std_{n}",
                 f"max(part_bloc) over {fr} as part_bloc_roll_max_{n}", f"avg(taux_participation_bv) over {fr} as taux_participation_roll_mean_{n}"]
    cols += ["lag(part_bloc,1) over w as y_lag1_bv", "lag(part_bloc,2) over w as y_lag2_bv",
             "avg(part_bloc) over (w rows between 3 preceding and 1 preceding) as y_rollmean_3_bv"]
    lags = f"""mt_lags as (
 select * exclude (part_bloc_lag1, ecart_bloc_vs_national_lag1, taux_participation_bv_lag1), {', '.join(cols)}
 from mt_cal window w as (partition by code_bv, bloc order by date_scrutin, type_scrutin, tour))"""
    town = """mt_town as (
 select code_commune, bloc, date_scrutin, lag(y_comm,1) over (partition by code_commune, bloc order by date_scrutin) as y_comm_lag1 from (
  select code_commune, bloc, date_scrutin,
   case when count(part_bloc) > 0 and count(part_bloc) = count(*) then
     sum(part_bloc * greatest(coalesce(exprimes,1.0),1.0)) / sum(case when part_bloc is not null then greatest(coalesce(exprimes,1.0),1.0) end) end as y_comm
  from mt_lags group by code_commune, bloc, date_scrutin) t)"""
    final = """mt_final as (
 select l.*, l.y_lag1_bv - l.y_lag2_bv as y_trend_bv, t.y_comm_lag1,
  l.voix_bloc/nullif(l.inscrits,0) as voix_bloc_sur_inscrits, l.exprimes/nullif(l.inscrits,0) as exprimes_sur_inscrits,
  l.votants/nullif(l.inscrits,0) as votants_sur_inscrits, l.part_bloc_lag1*l.taux_participation_bv as part_bloc_lag1_x_participation,
  l.part_bloc_lag1*l.ecart_bloc_vs_national as part_bloc_lag1_x_ecart_nat, l.taux_participation_bv*l.ecart_bloc_vs_national as participation_x_ecart_nat,
  l.part_bloc_lag1 - l.part_bloc_lag2 as part_bloc_trend_1, l.part_bloc_lag1 - l.part_bloc_lag4 as part_bloc_trend_2
 from mt_lags l left join mt_town t on l.code_commune = t.code_commune and l.bloc = t.bloc and l.date_scrutin = t.date_scrutin
 where l.part_bloc is not null)"""
    return [*fb_ctes(base_year), base, cal, lags, town, final]


# ---------------------------------------------------------------- scoring family
def score_features_sql(target_type: str, target_year: int) -> str:
    d = f"""sc_d as (select *, share - share_nat as dev_to_nat,
  row_number() over (partition by code_bv, category order by date_scrutin desc, election_type desc, round desc) as rn
 from fx_ec where election_year < {target_year})"""
    cols = [
        "arg_max(turnout_pct, date_scrutin) filter (where turnout_pct is not null) as prev_turnout_any_lag1",
        f"arg_max(turnout_pct, date_scrutin) filter (where turnout_pct is not null and election_type = '{target_type}') as prev_turnout_same_type_lag1",
    ]
    for c in CATEGORIES:
        t = f"election_type = '{target_type}'"
        cols += [
            f"arg_max(share, date_scrutin) filter (where category = '{c}' and share is not null) as prev_share_any_lag1_{c}",
            f"arg_max(share, date_scrutin) filter (where category = '{c}' and share is not null and {t}) as prev_share_type_lag1_{c}",
            f"arg_max(dev_to_nat, date_scrutin) filter (where category = '{c}' and dev_to_nat is not null) as prev_dev_to_national_any_lag1_{c}",
            f"arg_max(dev_to_nat, date_scrutin) filter (where category = '{c}' and dev_to_nat is not null and {t}) as prev_dev_to_national_type_lag1_{c}",
            f"max(case when category = '{c}' and rn = 1 then share end) - max(case when category = '{c}' and rn = 2 then share end) as swing_any_{c}",
        ]
    g = f"sc_g as (select code_bv, {', '.join(cols)} from sc_d group by code_bv)"
    feats = ["prev_turnout_any_lag1", "prev_turnout_same_type_lag1"] + [
        f"{p}{c}" for c in CATEGORIES for p in ("prev_share_any_lag1_", "prev_share_type_lag1_", "prev_dev_to_national_any_lag1_", "prev_dev_to_national_type_lag1_", "swing_any_")
    ]
    return (
        with_ctes(FX_LONG, FX_MAP, FX_LOCAL, FX_LOCAL_RATES, FX_NAT, FX_EC, d, g)
        + f"select split_part(code_bv, '-', 1) as commune_code, code_bv, '{target_type}' as election_type, {target_year} as election_year, 1 as round, "
        + f"make_date({target_year}, 1, 1) as date_scrutin, "
        + ", ".join(f"{r6(f)} as {f}" for f in feats)
        + " from sc_g"
    )
