"""Registered queries: scalar column functions, filters, set/sort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from votepanel.constants import EUROPEAN_LIST_RULES, PRESIDENTIAL_NAME_RULES
from votepanel.functions import codes as CD
from votepanel.functions.categories import category_from_list, category_from_name, normalise_bloc, normalise_category
from votepanel.functions.text import canonical_label, name_key, normalise_code, repair_mojibake, strip_accents
from votepanel.operators.clean import filter_department, prepare_long
from votepanel.operators.mapping import mapping_override, unmapped_codes
from votepanel.plans import oracle as O
from votepanel.plans.catalog import register
from votepanel.plans.queries_core import local_table, long_table, mapping_table
from votepanel.session import round_doubles
from votepanel.sources.tables import first_station, fx_dirty, fx_mapping, read_table

_CATS = ["centre", "gauche_modere", "droite_modere", "gauche_dure", "droite_dure", "extreme_gauche", "extreme_droite"]


def documents(spark, sf):
    return read_table(spark, sf, "documents", ["doc_id", "text"])


# ------------------------------------------------------------------ text keys over whole documents
@register("strip_accents_key", "select doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') as name_key from documents")
def q_strip_accents_key(spark, sf):
    return documents(spark, sf).select("doc_id", name_key("text").alias("name_key"))


@register("canonical_label", "select doc_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') as label_key from documents")
def q_canonical_label(spark, sf):
    return documents(spark, sf).select("doc_id", canonical_label("text").alias("label_key"))


def _first_hit_sql(rules) -> str:
    words = ", ".join(f"'{k}'" for k, _ in rules)
    key = "regexp_replace(strip_accents(lower(named)), '[^a-z]', '', 'g')"
    hit = "case when " + key + " = '' then null " + " ".join(f"when contains({key}, '{k}') then '{c}'" for k, c in rules) + " end"
    return f"select doc_id, {hit} as category from (select doc_id, concat_ws(' ', text, upper(([{words}])[doc_id % {len(rules) + 4} + 1])) as named from documents) d"


def named_documents(spark, sf, rules):
    """Documents that end with a word of ``rules``, by doc_id; four of every round of the words end with none."""
    word = F.get(F.array(*[F.lit(k) for k, _ in rules]), (F.col("doc_id") % (len(rules) + 4)).cast("int"))
    return documents(spark, sf).select("doc_id", F.concat_ws(" ", "text", F.upper(word)).alias("named"))


@register("category_from_name", _first_hit_sql(PRESIDENTIAL_NAME_RULES))
def q_category_from_name(spark, sf):
    return named_documents(spark, sf, PRESIDENTIAL_NAME_RULES).select("doc_id", category_from_name("named").alias("category"))


@register("category_from_list", _first_hit_sql(EUROPEAN_LIST_RULES))
def q_category_from_list(spark, sf):
    return named_documents(spark, sf, EUROPEAN_LIST_RULES).select("doc_id", category_from_list("named").alias("category"))


def _mojibake_sql() -> str:
    from votepanel.functions.text import MOJIBAKE_PAIRS

    e = "replace(broken, chr(65279), '')"
    for bad, good in MOJIBAKE_PAIRS:
        e = f"replace({e}, '{bad}', '{good}')"
    bad = "replace(replace(replace(text, 'e', 'Ã©'), 'o', 'Ã´'), 'C', chr(65279) || 'Ã‡')"
    return f"""select doc_id, regexp_replace(regexp_replace({e}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as text
 from (select doc_id, case when doc_id % 2 = 0 then {bad} else text end as broken from documents) d"""


@register("repair_mojibake", _mojibake_sql)
def q_repair_mojibake(spark, sf):
    """Every second document carries letters that were decoded wrongly, and byte order marks."""
    broken = F.col("text")
    for good, bad in (("e", "Ã©"), ("o", "Ã´"), ("C", "﻿Ã‡")):
        broken = F.replace(broken, F.lit(good), F.lit(bad))
    text = F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", repair_mojibake(text).alias("text"))


@register("strip_accents", "select doc_id, strip_accents(text) as text from documents")
def q_strip_accents(spark, sf):
    return documents(spark, sf).select("doc_id", strip_accents("text").alias("text"))


# ------------------------------------------------------------------ party codes and bloc labels
FXD = O.with_ctes(O.FX_LONG, O.FX_DIRTY)


@register(
    "normalise_code",
    FXD + """select code_bv, type_scrutin, annee, tour, code_candidature as raw_code,
 case when upper(trim(code_candidature)) in ('NAN', 'NONE', '', '<NA>') then null else upper(trim(code_candidature)) end as code from fx_dirty""",
)
def q_normalise_code(spark, sf):
    d = fx_dirty(spark, sf)
    return d.select("code_bv", "type_scrutin", "annee", "tour", F.col("code_candidature").alias("raw_code"), normalise_code("code_candidature").alias("code"))


# Raw bloc labels as found in mapping files (spellings, case, separators, unknown values).
RAW_BLOC_LABELS = ("Gauche", "droite moderee", "Divers", "EXTREME-DROITE", " gauche_dure ", "doite_dure", "divers_gauche",
                   "autre", "Centre", "extreme gauche", "divers centre", "Droite")


def _labels_sql() -> str:
    arr = "[" + ", ".join(f"'{x}'" for x in RAW_BLOC_LABELS) + "]"
    return f"select p_partkey, {arr}[p_size % {len(RAW_BLOC_LABELS)} + 1] as label from part"


def _label_key_sql(c: str) -> str:
    return f"replace(replace(lower(trim({c})), ' ', '_'), '-', '_')"


def _syn_sql(c: str, syn: dict) -> str:
    k = _label_key_sql(c)
    return "case " + " ".join(f"when {k} = '{a}' then {('null' if b is None else repr(b))}" for a, b in syn.items()) + f" else {k} end"


def labels(spark, sf):
    arr = F.array(*[F.lit(x) for x in RAW_BLOC_LABELS])
    p = read_table(spark, sf, "part", ["p_partkey", "p_size"])
    return p.select("p_partkey", F.element_at(arr, (F.col("p_size") % len(RAW_BLOC_LABELS) + 1).cast("int")).alias("label"))


@register(
    "normalise_bloc",
    lambda: "with l as (" + _labels_sql() + ") select p_partkey, label, "
    + "case when label is null then 'centre' when (" + _syn_sql("label", __import__("votepanel.constants", fromlist=["x"]).CATEGORY_SYNONYMS_LENIENT)
    + f") in ({', '.join(repr(c) for c in _CATS)}) then (" + _syn_sql("label", __import__("votepanel.constants", fromlist=["x"]).CATEGORY_SYNONYMS_LENIENT)
    + ") else 'centre' end as bloc, case when (" + _syn_sql("label", __import__("votepanel.constants", fromlist=["x"]).CATEGORY_SYNONYMS_STRICT)
    + f") in ({', '.join(repr(c) for c in _CATS)}) then (" + _syn_sql("label", __import__("votepanel.constants", fromlist=["x"]).CATEGORY_SYNONYMS_STRICT) + ") end as category from l",
)
def q_normalise_bloc(spark, sf):
    lab = labels(spark, sf)
    return lab.select("p_partkey", "label", normalise_bloc("label").alias("bloc"), normalise_category("label").alias("category"))


# ------------------------------------------------------------------ town / station codes
@register(
    "normalise_insee",
    """select s_suppkey, case when d = '' then null when length(d) >= 5 then substr(d, 1, 5) else lpad(d, 5, '0') end as code_commune from (
 select s_suppkey, regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[^0-9]', '', 'g') as d from (
  select s_suppkey, case when s_suppkey % 3 = 0 then cast(s_nationkey as varchar) || '.0' when s_suppkey % 3 = 1 then ' ' || cast(s_nationkey * 1000 + s_suppkey as varchar)
   else 'T' || cast(s_nationkey as varchar) end as raw from supplier) r) x""",
)
def q_normalise_insee(spark, sf):
    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    raw = (F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")))
           .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" "), (F.col("s_nationkey") * 1000 + F.col("s_suppkey")).cast("string")))
           .otherwise(F.concat(F.lit("T"), F.col("s_nationkey").cast("string"))))
    return s.select("s_suppkey", CD.normalise_insee(raw).alias("code_commune"))


@register(
    "normalise_geo_codes",
    """with r as (select s_suppkey, cast(s_nationkey % 100 as varchar) || '.0' as dept, cast(s_suppkey % 1000 as varchar) as town, cast(s_suppkey as varchar) as st from supplier),
 c as (select s_suppkey, lpad(regexp_replace(regexp_replace(trim(dept), '\\.0$', ''), '[^0-9]', '', 'g'), 2, '0') as d,
   regexp_replace(regexp_replace(trim(town), '\\.0$', ''), '[^0-9]', '', 'g') as t,
   lpad(regexp_replace(regexp_replace(trim(st), '\\.0$', ''), '[^0-9]', '', 'g'), 4, '0') as s from r)
 select s_suppkey, d as dept, case when length(t) = 5 then t when length(t) <= 3 then d || lpad(t, 3, '0') else lpad(t, 5, '0') end as town, s as station,
  (case when length(t) = 5 then t when length(t) <= 3 then d || lpad(t, 3, '0') else lpad(t, 5, '0') end) || s as key9 from c""",
)
def q_normalise_geo_codes(spark, sf):
    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    d, t, st, k = CD.normalise_geo_codes(F.concat((F.col("s_nationkey") % 100).cast("string"), F.lit(".0")), (F.col("s_suppkey") % 1000).cast("string"), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", d.alias("dept"), t.alias("town"), st.alias("station"), k.alias("key9"))


@register("split_key", O.with_ctes(O.FX_LONG) + "select distinct code_bv, split_part(code_bv, '-', 1) as town, regexp_replace(code_bv, '^[^-]*-', '') as station from fx_long")
def q_split_key(spark, sf):
    t, s = CD.split_key("code_bv")
    return long_table(spark, sf).select("code_bv", t.alias("town"), s.alias("station")).distinct()


@register(
    "extract_station_number",
    "select s_suppkey, s_name, cast(nullif(regexp_extract(s_name, '([0-9]+)', 1), '') as integer) as station_number from supplier",
)
def q_extract_station_number(spark, sf):
    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_name"])
    return s.select("s_suppkey", "s_name", CD.extract_station_number("s_name").alias("station_number"))


@register(
    "format_delta",
    """with c as (select c_custkey, c_acctbal as v, cast(abs(round(c_acctbal * 100)) as bigint) as a from customer),
 t as (select c_custkey, v, a // 10 + case when a % 10 > 5 or (a % 10 = 5 and (a // 10) % 2 = 1) then 1 else 0 end as tenths from c)
 select c_custkey, case when v is null then 'N/A' else concat(case when v >= 0 then '+' else '-' end, tenths // 10, '.', tenths % 10) end as delta from t""",
)
def q_format_delta(spark, sf):
    return read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"]).select("c_custkey", CD.format_delta("c_acctbal").alias("delta"))


@register(
    "event_key",
    O.with_ctes(O.FX_LONG) + "select distinct lower(trim(type_scrutin)) || '|' || cast(annee as varchar) || '|' || cast(tour as varchar) as event_key, type_scrutin, annee, tour from fx_long",
)
def q_event_key(spark, sf):
    lg = long_table(spark, sf)
    k = CD.event_key("election_type", "election_year", "round")
    t, y, r = CD.parse_event_key(k)
    return lg.select(k.alias("event_key"), t.alias("type_scrutin"), y.alias("annee"), r.alias("tour")).distinct()


@register(
    "build_station_key",
    """select s_suppkey, case when cast(s_nationkey as varchar) ~ '^[0-9]+$' and length(cast(s_nationkey as varchar)) < 3 then lpad(cast(s_nationkey as varchar), 3, '0') else cast(s_nationkey as varchar) end
  || '-' || case when length(cast(s_suppkey as varchar)) < 3 then lpad(cast(s_suppkey as varchar), 3, '0') else cast(s_suppkey as varchar) end as code_bv from supplier""",
)
def q_build_station_key(spark, sf):
    from votepanel.sources.delimited import build_station_key

    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]).select(
        "s_suppkey", F.col("s_nationkey").cast("string").alias("town"), F.col("s_suppkey").cast("string").alias("station"))
    return build_station_key(s, ["town", "station"]).select("s_suppkey", "code_bv")


# ------------------------------------------------------------------ cleaning of the long table
@register(
    "basic_cleaning",
    FXD + """select code_bv, type_scrutin, annee, tour, code_candidature, coalesce(voix, 0.0) as voix,
 case when exprimes is null and votants is not null and blancs is not null and nuls is not null then votants - blancs - nuls else exprimes end as exprimes
 from fx_dirty where code_bv is not null""",
)
def q_basic_cleaning(spark, sf):
    from votepanel.sources.delimited import basic_cleaning

    d = basic_cleaning(fx_dirty(spark, sf))
    return d.select("code_bv", "type_scrutin", "annee", "tour", "code_candidature", "voix", "exprimes")


@register("positive_votes", FXD + "select code_bv, type_scrutin, annee, tour, code_candidature, voix from fx_dirty where voix is not null and voix > 0")
def q_positive_votes(spark, sf):
    d = fx_dirty(spark, sf)
    return d.where(F.col("voix").isNotNull() & (F.col("voix") > 0)).select("code_bv", "type_scrutin", "annee", "tour", "code_candidature", "voix")


@register(
    "unmapped_codes",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY, O.FX_MAP) + """, d as (select case when upper(trim(code_candidature)) in ('NAN', 'NONE', '', '<NA>') then null else upper(trim(code_candidature)) end as code_candidature, voix from fx_dirty)
 select code_candidature, count(*) as n_rows, coalesce(sum(voix), 0.0) as voix from d
 where code_candidature is not null and code_candidature not in (select upper(code_candidature) from fx_map) group by code_candidature""",
)
def q_unmapped_codes(spark, sf):
    return unmapped_codes(prepare_long(fx_dirty(spark, sf)), mapping_table(spark, sf))


# override rows: one existing code re-mapped, one code appended (a configuration, applied to the full mapping)
OVERRIDES = [("Brand#7", None, ["droite_dure"]), ("Brand#25", "Brand#25", ["centre", "gauche_modere"])]


@register(
    "mapping_override",
    O.with_ctes(O.FX_MAP) + """, base as (select upper(code_candidature) as code_candidature, code_candidature as nom_candidature, max(case when k = 0 then category end) as bloc_1,
   max(case when k = 1 then category end) as bloc_2, max(case when k = 2 then category end) as bloc_3 from fx_map group by code_candidature),
 ov as (select * from (values ('BRAND#7', null, 'droite_dure', null, null), ('BRAND#25', 'Brand#25', 'centre', 'gauche_modere', null)) v(code_candidature, nom_candidature, bloc_1, bloc_2, bloc_3))
 select coalesce(b.code_candidature, o.code_candidature) as code_candidature, coalesce(o.nom_candidature, b.nom_candidature) as nom_candidature,
  coalesce(o.bloc_1, b.bloc_1) as bloc_1, coalesce(o.bloc_2, b.bloc_2) as bloc_2, coalesce(o.bloc_3, b.bloc_3) as bloc_3
 from base b full outer join ov o on b.code_candidature = o.code_candidature""",
)
def q_mapping_override(spark, sf):
    ov = spark.createDataFrame([(c, n, b) for c, n, b in OVERRIDES], "code string, nom string, blocs array<string>")
    return mapping_override(fx_mapping(spark, sf), ov)


# ------------------------------------------------------------------ filters
@register(
    "filter_department",
    O.with_ctes(O.FX_LONG) + """select code_bv, type_scrutin, annee, tour, lower(code_candidature) as code_candidature, voix from fx_long
 where case when cast(code_commune as int) % 3 = 0 then substr(code_commune, 1, 2) else lpad(cast(cast(code_commune as int) % 5 as varchar), 2, '0') end = '00'""",
)
def q_filter_department(spark, sf):
    """Two towns of three name a department; the others fall back to the start of the town code."""
    town = F.col("commune_code").cast("int")
    out = filter_department(long_table(spark, sf).withColumn("dept", F.when(town % 3 != 0, F.lpad((town % 5).cast("string"), 2, "0"))), "00")
    return out.select("code_bv", F.col("election_type").alias("type_scrutin"), F.col("election_year").alias("annee"), F.col("round").alias("tour"),
                      F.lower("code_candidature").alias("code_candidature"), "voix")


@register(
    "history_slice",
    O.with_ctes(O.FX_LONG) + "select code_bv, type_scrutin, annee, tour, lower(code_candidature) as code_candidature, voix from fx_long where code_bv = (select min(code_bv) from fx_long) and type_scrutin = 'low' and annee = 1998 and tour = 1",
)
def q_history_slice(spark, sf):
    lg = long_table(spark, sf, first_station(spark, sf))
    out = lg.where((F.col("election_type") == "low") & (F.col("election_year") == 1998) & (F.col("round") == 1))
    return out.select("code_bv", F.col("election_type").alias("type_scrutin"), F.col("election_year").alias("annee"), F.col("round").alias("tour"),
                      F.lower("code_candidature").alias("code_candidature"), "voix")


@register(
    "filter_scope",
    O.with_ctes(O.FX_LONG) + """select distinct l.code_bv, l.type_scrutin, l.annee from fx_long l join nation n on l.code_commune = lpad(cast(n.n_nationkey as varchar), 5, '0')
 where (n.n_name like '%ATION_1%' or l.code_bv like '00002-%') and l.type_scrutin = 'high' and l.tour = 1""",
)
def q_filter_scope(spark, sf):
    lg = long_table(spark, sf)
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name"]).select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("commune_code"), "n_name")
    j = lg.join(F.broadcast(n), on="commune_code", how="inner")
    cond = (F.col("n_name").contains("ATION_1") | F.col("code_bv").startswith("00002-")) & (F.col("election_type") == "high") & (F.col("round") == 1)
    return j.where(cond).select("code_bv", F.col("election_type").alias("type_scrutin"), F.col("election_year").alias("annee")).distinct()


@register(
    "search_commune",
    O.with_ctes(O.FX_LONG) + """select distinct l.code_commune, n.n_name from fx_long l join nation n on l.code_commune = lpad(cast(n.n_nationkey as varchar), 5, '0')
 where contains(regexp_replace(strip_accents(lower(n.n_name)), '[^a-z0-9]', '', 'g'), 'nation1')""",
)
def q_search_commune(spark, sf):
    lg = long_table(spark, sf).select(F.col("commune_code").alias("code_commune")).distinct()
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name"]).select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code_commune"), "n_name")
    key = F.regexp_replace(strip_accents(F.lower("n_name")), "[^a-z0-9]", "")
    return lg.join(F.broadcast(n.where(key.contains("nation1"))), on="code_commune", how="inner").select("code_commune", "n_name")


# ------------------------------------------------------------------ sort / limit / set operators
@register(
    "top_n",
    O.with_ctes(O.FX_LONG) + "select upper(code_candidature) as code_candidature, count(*) as n from fx_long group by 1 order by n desc, code_candidature limit 10",
)
def q_top_n(spark, sf):
    # top-k report: the limit is the feature
    lg = long_table(spark, sf)
    return lg.groupBy("code_candidature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "code_candidature").limit(10)


@register(
    "fetch_history",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES) + f"select code_bv, date_scrutin, category, {O.r6('share')} as share from fx_rates where code_bv = (select min(code_bv) from fx_rates) order by date_scrutin, category",
)
def q_fetch_history(spark, sf):
    loc = local_table(spark, sf, first_station(spark, sf))
    return round_doubles(loc.select("code_bv", "date_scrutin", "category", "share").orderBy("date_scrutin", "category"))


@register(
    "station_timeseries",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + f"select date_scrutin, category, {O.r6('share')} as share from fx_rates where code_bv = (select min(code_bv) from fx_rates) and round = 1 order by date_scrutin",
)
def q_station_timeseries(spark, sf):
    loc = local_table(spark, sf, first_station(spark, sf)).where(F.col("round") == 1)
    return round_doubles(loc.select("date_scrutin", "category", "share").orderBy("date_scrutin"))


@register(
    "union_frames",
    O.with_ctes(O.FX_LONG) + """select code_bv, type_scrutin, annee, tour, lower(code_candidature) as code_candidature, voix, null::double as nuls from fx_long where tour = 1
 union all select code_bv, type_scrutin, annee, tour, lower(code_candidature) as code_candidature, voix, nuls from fx_long where tour = 2""",
)
def q_union_frames(spark, sf):
    lg = long_table(spark, sf).select("code_bv", F.col("election_type").alias("type_scrutin"), F.col("election_year").alias("annee"),
                                      F.col("round").alias("tour"), F.lower("code_candidature").alias("code_candidature"), "voix", "nuls")
    r1 = lg.where(F.col("tour") == 1).drop("nuls")
    r2 = lg.where(F.col("tour") == 2)
    return r1.unionByName(r2, allowMissingColumns=True)


DEFAULT_TARGETS = [("low", 2002), ("high", 2003), ("urgent", 2003)]


@register(
    "available_targets",
    O.with_ctes(O.FX_LONG) + "select distinct type_scrutin as election_type, annee as election_year from fx_long union select * from (values ('low', 2002), ('high', 2003), ('urgent', 2003)) v(a, b) order by 1, 2",
)
def q_available_targets(spark, sf):
    obs = long_table(spark, sf).select("election_type", "election_year").distinct()
    dflt = spark.createDataFrame(DEFAULT_TARGETS, "election_type string, election_year int")
    return obs.union(dflt).distinct().orderBy("election_type", "election_year")


@register(
    "category_scaffold",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + f""", s as (select code_bv, election_type, election_year, round, category, avg(share) as share from fx_rates group by all),
 k as (select distinct code_bv, election_type, election_year, round from fx_rates)
 select k.code_bv, k.election_type, k.election_year, k.round, c.category, {O.r6('coalesce(s.share, 0.0)')} as share
 from k cross join (values {", ".join(f"('{c}')" for c in _CATS)}) c(category) left join s using (code_bv, election_type, election_year, round, category)""",
)
def q_category_scaffold(spark, sf):
    """All seven categories of every station-election, 0 where it has no row of one: a pivot with fixed columns, taken apart again."""
    from votepanel.constants import CATEGORIES

    keys = ["code_bv", "election_type", "election_year", "round"]
    wide = local_table(spark, sf).groupBy(*keys).agg(*[F.avg(F.when(F.col("category") == c, F.col("share"))).alias(c) for c in CATEGORIES])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(c, F.lit(0.0)).alias("share")) for c in CATEGORIES]))
    return round_doubles(wide.select(*keys, rows.alias("x")).select(*keys, "x.*"))


@register("sample_rows", O.with_ctes(O.FX_LONG) + "select code_bv from (select distinct code_bv from fx_long) order by md5(code_bv || ':42'), code_bv limit 20")
def q_sample_rows(spark, sf):
    """Repeatable seeded sample of 20 stations (order by a seeded digest): the limit is the feature."""
    from votepanel.operators.stations import sample_keys

    return sample_keys(long_table(spark, sf).select("code_bv").distinct(), "code_bv", 20, seed=42)


@register(
    "common_columns",
    """select o_custkey as custkey, 'orders' as source from orders where o_custkey is not null union all select c_custkey, 'customer' from customer where c_custkey is not null""",
)
def q_common_columns(spark, sf):
    """Rows of two sources over the columns they have in common (names without their table prefix)."""
    frames = {}
    for t in ("orders", "customer"):
        df = read_table(spark, sf, t)
        frames[t] = df.select(*[F.col(c).alias(c.split("_", 1)[1]) for c in df.columns])
    common = [c for c in frames["orders"].columns if c in frames["customer"].columns and c != "comment"]
    orders, customer = (df.select(*common, F.lit(t).alias("source")) for t, df in frames.items())
    return orders.unionByName(customer).where(F.col("custkey").isNotNull())
