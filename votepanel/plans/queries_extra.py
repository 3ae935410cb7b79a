"""Registered queries for the remaining SURVEY section 2 keys: stages of the composite plans exposed on
their own, ingest helpers over derived raw files, display tables, rate choice and model evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES, DISPLAY_ORDER, INDEX_COLS, PANEL_FEATURES, TARGET_COLS
from votepanel.operators import forecast as FC
from votepanel.operators import metrics as ME
from votepanel.operators import ml as ML
from votepanel.operators import scenario as SCN
from votepanel.operators.aggregate import nz
from votepanel.operators.mapping import join_mapping
from votepanel.operators.reshape import pivot_category
from votepanel.plans import oracle as O
from votepanel.plans.catalog import register
from votepanel.plans.panel import event_category_table, renormalise_targets
from votepanel.plans.queries_core import TARGET_TYPE, TARGET_YEAR, local_table, long_table, mapping_table, q_build_panel
from votepanel.plans.queries_more import (
    _CAL, _DIMS_SQL, _INTER, _MULTI, _ROLL, _STD, _TREND, BASE_YEAR, PN_LONG, RAW_RENAME, _pn, blocs_table, all_towns, write_raw_results,
)
from votepanel.session import cut_lineage, round_doubles, scratch_path
from votepanel.sources import delimited as DL
from votepanel.sources.tables import fx_long

_CATS = list(CATEGORIES)


# ------------------------------------------------------------------ stages of the panel plan
def _panel_pre(spark, sf):
    from votepanel.operators.windows import panel_lags, turnout_lags

    local = event_category_table(long_table(spark, sf), mapping_table(spark, sf))
    wide = pivot_category(panel_lags(local), INDEX_COLS, PANEL_FEATURES, extra=[F.max("turnout_pct").alias("turnout_pct"), F.count("share").alias("_n_share")])
    return turnout_lags(wide).where(F.col("_n_share") > 0).drop("_n_share")


@register(
    "pivot_category",
    lambda: O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, O.FX_NAT, O.FX_EC, O.FX_LAGS)
    + "select " + ", ".join(INDEX_COLS) + ", " + ", ".join(f"{O.r6(f'avg(case when category = {chr(39)}{c}{chr(39)} then share end)')} as target_share_{c}" for c in _CATS)
    + " from fx_lags group by " + ", ".join(INDEX_COLS) + " having count(share) > 0",
)
def q_pivot_category(spark, sf):
    return round_doubles(_panel_pre(spark, sf).select(*INDEX_COLS, *TARGET_COLS))


@register("renormalise_targets", lambda: f"with pn as ({O.panel_sql()}) select code_bv, election_type, election_year, round, " + ", ".join(TARGET_COLS) + ", target_sum_before_renorm, target_sum_after_renorm from pn")
def q_renormalise_targets(spark, sf):
    return q_build_panel(spark, sf).select("code_bv", "election_type", "election_year", "round", *TARGET_COLS, "target_sum_before_renorm", "target_sum_after_renorm")


@register("turnout_lags", lambda: f"with pn as ({O.panel_sql()}) select code_bv, election_type, election_year, round, turnout_pct, prev_turnout_any_lag1, prev_turnout_same_type_lag1 from pn")
def q_turnout_lags(spark, sf):
    return q_build_panel(spark, sf).select("code_bv", "election_type", "election_year", "round", "turnout_pct", "prev_turnout_any_lag1", "prev_turnout_same_type_lag1")


@register(
    "join_panel_parts",
    lambda: f"with pn as ({O.panel_sql()}) select code_bv, election_type, election_year, round, "
    + ", ".join(f"{p}{c}" for p, _ in PANEL_FEATURES[1:] for c in _CATS) + " from pn",
)
def q_join_panel_parts(spark, sf):
    return q_build_panel(spark, sf).select("code_bv", "election_type", "election_year", "round", *[f"{p}{c}" for p, _ in PANEL_FEATURES[1:] for c in _CATS])


@register(
    "join_mapping",
    O.with_ctes(O.FX_LONG, O.FX_MAP) + """, mw as (select upper(code_candidature) as code_candidature, max(case when k = 0 then category end) as bloc_1,
  max(case when k = 1 then category end) as bloc_2, max(case when k = 2 then category end) as bloc_3 from fx_map group by code_candidature)
 select l.code_bv, l.type_scrutin as election_type, l.annee as election_year, l.tour as round, upper(l.code_candidature) as code_candidature, l.voix, m.bloc_1, m.bloc_2, m.bloc_3
 from fx_long l left join mw m on upper(l.code_candidature) = m.code_candidature""",
)
def q_join_mapping(spark, sf):
    j = join_mapping(long_table(spark, sf), mapping_table(spark, sf))
    return j.select("code_bv", "election_type", "election_year", "round", "code_candidature", "voix", "bloc_1", "bloc_2", "bloc_3")


@register(
    "join_growth",
    lambda: O.with_ctes(*O.fb_ctes(BASE_YEAR)) + f"select distinct code_bv, annee, {O.r6('croissance_inscrits_depuis_base')} as croissance_inscrits_depuis_base from fb_lags",
)
def q_join_growth(spark, sf):
    return round_doubles(blocs_table(spark, sf).select("code_bv", "annee", "croissance_inscrits_depuis_base").distinct())


@register(
    "allocate_counts",
    lambda: O.with_ctes(*O.forecast_ctes(TARGET_TYPE, TARGET_YEAR)) + "select code_bv, categorie, nombre from fc_alloc",
)
def q_allocate_counts(spark, sf):
    blocs, _ = FC._trend_parts(local_table(spark, sf), TARGET_TYPE, TARGET_YEAR)
    return blocs.select("code_bv", "categorie", "nombre")


RATE_FIX = {"taux_participation": 0.65, "taux_blancs": None, "taux_nuls": 0.01}


@register(
    "rate_overrides",
    lambda: O.with_ctes(*O.forecast_ctes(TARGET_TYPE, TARGET_YEAR)).replace(
        "coalesce(taux_participation, 0.0) as p0", "coalesce(0.65, 0.0) as p0").replace("coalesce(taux_nuls, 0.0) as n0", "coalesce(0.01, 0.0) as n0")
    + "select code_bv, inscrits_total, votants_total, blancs_total, nuls_total, exprimes_total, abstention_total from fc_counts",
)
def q_rate_overrides(spark, sf):
    hist = FC.prepare_history(local_table(spark, sf), target_year=TARGET_YEAR)
    rates = SCN.rate_overrides(FC.project_rates(FC.station_events(hist), TARGET_TYPE, TARGET_YEAR), RATE_FIX)
    hc = FC.head_counts(rates).where(F.col("inscrits_total").isNotNull())
    return hc.select("code_bv", "inscrits_total", "votants_total", "blancs_total", "nuls_total", "exprimes_total", "abstention_total")


# ------------------------------------------------------------------ ingest helpers over the derived raw files
def _raw(spark, sf):
    path, types = write_raw_results(spark, sf)
    return DL.read_delimited(spark, path), path


@register(
    "rename_by_label",
    O.with_ctes(O.FX_LONG) + "select type_scrutin, cast(annee as varchar) as annee_brute, date_scrutin, code_candidature, exprimes, voix from fx_long",
)
def q_rename_by_label(spark, sf):
    """Rows under their new names; unmatched raw columns keep theirs."""
    raw, _ = _raw(spark, sf)
    df = DL.coerce_numeric(DL.rename_by_label(raw, RAW_RENAME))
    return df.select("type_scrutin", F.col("Année").alias("annee_brute"), F.to_date("Date").alias("date_scrutin"), "code_candidature", "exprimes", "voix")


@register(
    "dedupe_columns",
    O.with_ctes(O.FX_LONG) + "select code_bv, type_scrutin, annee, tour, code_candidature, voix from fx_long",
)
def q_dedupe_columns(spark, sf):
    """Two raw columns landing on ``code_candidature`` (a code column and a nuance column, null where the
    other is set) merge into their first non-null value."""
    raw, _ = _raw(spark, sf)
    odd = F.col("`Code B.Vote`").cast("int") % 2 == 0
    raw = raw.withColumn("Nuance", F.when(odd, F.col("Code Nuance"))).withColumn("Code Nuance", F.when(~odd, F.col("Code Nuance")))
    meta = {"tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin",
            "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4]}
    df = DL.rename_by_label(raw, {**RAW_RENAME, "Nuance": "code_candidature"})
    df = DL.coerce_numeric(DL.build_station_key(DL.add_event_metadata(df, meta), meta["code_bv_cols"], widths=meta["code_bv_widths"]))
    return df.select("code_bv", "type_scrutin", "annee", "tour", "code_candidature", "voix")


@register("coerce_numeric", O.with_ctes(O.FX_LONG) + "select inscrits, votants, blancs, nuls, exprimes, voix from fx_long")
def q_coerce_numeric(spark, sf):
    raw, _ = _raw(spark, sf)
    df = DL.coerce_numeric(DL.rename_by_label(raw, RAW_RENAME))
    return df.select("inscrits", "votants", "blancs", "nuls", "exprimes", "voix")


@register("add_event_metadata", O.with_ctes(O.FX_LONG) + "select type_scrutin, annee, tour, date_scrutin from fx_long")
def q_add_event_metadata(spark, sf):
    raw, _ = _raw(spark, sf)
    meta = {"tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin"}
    return DL.add_event_metadata(raw, meta).select("type_scrutin", "annee", "tour", "date_scrutin")


@register(
    "ensure_columns",
    O.with_ctes(O.FX_LONG) + """select code_bv, cast(null as varchar) as nom_bv, annee, date_scrutin, type_scrutin, tour, inscrits, votants, cast(null as double) as abstentions,
 blancs, nuls, exprimes, code_candidature, cast(null as varchar) as nom_candidature, voix from fx_long""",
)
def q_ensure_columns(spark, sf):
    """Rows of a standardised file with every standard column; missing ones are null."""
    path, types = write_raw_results(spark, sf)
    meta = {"path": path, "tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin",
            "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4], "rename_map": RAW_RENAME}
    return DL.standardise_election(spark, meta).select(*DL.STANDARD_COLUMNS)


@register(
    "order_columns",
    O.with_ctes(O.FX_LONG) + "select concat_ws('|', '', '', '', '', type_scrutin, '', "
    + ", ".join("''" if c is None else f"replace(cast({c} as varchar), '.', ',')" for c in ("inscrits", "votants", None, "blancs", "nuls", "exprimes"))
    + ", code_candidature, '', replace(cast(voix as varchar), '.', ',')) as record from fx_long",
)
def q_order_columns(spark, sf):
    """Leading columns of every row, joined in their order."""
    raw, _ = _raw(spark, sf)
    df = DL.order_columns(DL.ensure_columns(DL.rename_by_label(raw, RAW_RENAME)))
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns[: len(DL.STANDARD_COLUMNS)]]).alias("record"))


@register("standardise_election", O.with_ctes(O.FX_LONG) + "select " + ", ".join(_STD) + " from fx_long")
def q_standardise_election(spark, sf):
    path, _ = write_raw_results(spark, sf)
    meta = {"path": path, "tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin",
            "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4], "rename_map": RAW_RENAME}
    return DL.standardise_election(spark, meta).select(*_STD)


@register("split_rounds", O.with_ctes(O.FX_LONG) + "select code_bv, type_scrutin, annee, tour, date_scrutin, code_candidature, voix from fx_long")
def q_split_rounds(spark, sf):
    """A file holding both rounds: no split, the round column becomes an integer key of every row."""
    raw, _ = _raw(spark, sf)
    meta = {"tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin"}
    df = DL.add_event_metadata(DL.rename_by_label(raw, RAW_RENAME), meta)
    df = DL.coerce_numeric(DL.build_station_key(df, ["Code de la commune", "Code B.Vote"], widths=[5, 4]))
    return df.select("code_bv", "type_scrutin", "annee", "tour", "date_scrutin", "code_candidature", "voix")


@register("write_harmonised_per_source", O.with_ctes(O.FX_LONG) + "select type_scrutin as source, " + ", ".join(_STD) + " from fx_long")
def q_write_harmonised_per_source(spark, sf):
    lg = fx_long(spark, sf).withColumn("source", F.col("type_scrutin"))
    path = scratch_path(spark, "per_source")
    lg.write.mode("overwrite").partitionBy("source").parquet(path)
    return spark.read.parquet(path).select("source", *_STD)


@register("read_panel", lambda: f"with pn as ({O.panel_sql()}) select code_bv, election_type, election_year, round, " + ", ".join(TARGET_COLS) + " from pn")
def q_read_panel(spark, sf):
    path = scratch_path(spark, "panel")
    DL.write_dual(q_build_panel(spark, sf), path)
    back = spark.read.option("sep", ";").option("header", True).csv(f"{path}/csv")
    return back.select("code_bv", "election_type", F.col("election_year").cast("int").alias("election_year"), F.col("round").cast("int").alias("round"),
                       *[F.col(t).cast("double").alias(t) for t in TARGET_COLS])


@register("source_fallback", O.with_ctes(O.FX_LONG) + "select " + ", ".join(_STD) + " from fx_long")
def q_source_fallback(spark, sf):
    """First non-empty source among candidates, preferring one that carries blank/void counts: an empty
    source, a source without blank counts, then the full raw files."""
    from votepanel.sources.fallback import first_usable_source

    path, _ = write_raw_results(spark, sf)
    meta = {"path": path, "tour_column": "N° tour", "date_column": "Date", "year_column": "Année", "type_column": "type_scrutin",
            "code_bv_cols": ["Code de la commune", "Code B.Vote"], "code_bv_widths": [5, 4], "rename_map": RAW_RENAME}
    full = DL.standardise_election(spark, meta).select(*_STD)
    empty = full.limit(0)
    no_blank = full.withColumn("blancs", F.lit(None).cast("double"))
    return first_usable_source([lambda: empty, lambda: no_blank, lambda: full])


@register("write_metrics", "select 'mae_mean' as metric union all select 'rmse' union all select 'medae' union all select 'r2' union all select 'explained_var' union all select 'wape' union all select 'smape' union all select 'bias'")
def q_write_metrics(spark, sf):
    from votepanel.plans.queries_more import naive_diag
    from votepanel.sources.sinks import write_metrics

    m = ME.regression_metrics(ME.normalise_predictions(naive_diag(spark, sf)))
    path = write_metrics(m, scratch_path(spark, "metrics"))
    back = spark.read.json(f"{path}/json")
    return back.select("metric").where(~F.col("metric").startswith("mae_") | (F.col("metric") == "mae_mean"))


@register(
    "ingest_star",
    lambda: O.with_ctes(_pn(), PN_LONG(), _DIMS_SQL)
    + f"select bureau_id, election_id, category_id, {O.r6('round_even(share * 100, 6)')} as share_pct, {O.r6('turnout_pct * 100')} as turnout_pct from lk",
)
def q_ingest_star(spark, sf):
    """Panel -> mass check -> melt -> dimensions -> key lookups -> facts; the local facts of the years to 1999 are loaded first, those of the
    later ones merged into the partitions of their stations, and the table read back."""
    from votepanel.operators.quality import check_mass
    from votepanel.plans import warehouse as WH

    panel = q_build_panel(spark, sf)
    _bad = check_mass(panel)  # warn-level in the original: the rows are available to the caller
    lp = WH.melt_panel(panel)
    dims = WH.star_dimensions(lp)
    path = scratch_path(spark, "star")
    WH.write_star({**dims, "results_national": WH.star_facts(lp, dims)["results_national"]}, path)
    facts, part = f"{path}/results_local", WH.key_range("bureau_id", 1000)
    WH.create_merge_table(WH.star_facts(lp.where(F.col("election_year") <= 1999), dims)["results_local"], facts, part)
    later = WH.star_facts(lp.where(F.col("election_year") > 1999), dims)["results_local"]
    loaded = WH.merge_table(spark, facts, later, ["bureau_id", "election_id", "category_id"], part)
    return round_doubles(loaded.select("bureau_id", "election_id", "category_id", "share_pct", "turnout_pct"))


# ------------------------------------------------------------------ header labels: a file a station, its columns drawn from the raw vocabulary
from votepanel.functions import labels as LB  # noqa: E402

# Raw labels as they occur in result files, with wrong decodings and numbered fields.
RAW_LABELS = (
    "Code du département", "Code du d°partement", "Libellé département", "Code commune", "Libellé commune", "Code B.Vote", "Code BV", "N° tour", "Inscrits", "Abstentions", "Votants", "Votants 1", "Blancs", "Nuls",
    "Exprimés", "Exprim°s", "Exprimés 2", "% Vot/Ins", "% Abstentions", "% Blancs / Inscrits", "% Voix/Ins 2", "% Voix / Exprimés", "N.Pan. 3", "N°Panneau 1", "NÂ°Panneau 1", "N° de dépôt de la liste 4", "N°Liste",
    "Sexe", "Sexe candidat 2", "Nom", "Nom 3", "Nom.1", "Nom candidat 1", "Nom du candidat tête de liste", "Nom Tête de Liste", "Nom T°te de Liste 1", "Prénom", "Pr°nom du candidat t°te de liste", "Prénom candidat 2",
    "Nuance", "Nuance Liste", "Nuance candidat 5", "Code Nuance", "Code Nuance 2", "Code nuance du candidat", "Liste", "Liste.1", "Libellé abrégé de liste 2", "Libell° Abr°g° Liste 1", "Libellé Etendu Liste", "Libellé de liste 1",
    "Voix", "Voix 7", "Nombre de voix du candidat", "Binôme", "ExprimÃ©s", "Libellé de la circonscription", "Commentaire",
)
N_COLUMNS = 24


def _labels_sql() -> str:
    names = ", ".join("'" + x.replace("'", "''") + "'" for x in RAW_LABELS)
    fold = "label"
    from votepanel.functions.text import MOJIBAKE_PAIRS

    for bad, good in (("\ufeff", ""), *MOJIBAKE_PAIRS):
        fold = f"replace({fold}, '{bad}', '{good}')"
    key = f"regexp_replace(strip_accents(lower(regexp_replace(trim(regexp_replace({fold}, '\\s+', ' ', 'g')), 'Â?[°º]', '', 'g'))), '\\s*/\\s*', '/', 'g')"
    whens = []
    for pattern, name, policy in LB.RULES:
        value = f"'{name}'" if policy == "drop" else f"case when num <> '' then '{name} ' || num else '{name}{' 1' if policy == 'first' else ''}' end"
        whens.append(f"when regexp_full_match(key, '{pattern}') then {value}")
    return f"""with raw as (select s_suppkey as file, p.p as position, ([{names}])[(s_suppkey * 7 + p.p * 5) % {len(RAW_LABELS)} + 1] as label from supplier, range(1, {N_COLUMNS + 1}) p(p)),
 k as (select *, {key} as key from raw), n as (select *, regexp_extract(key, '([0-9]+)', 1) as num from k),
 h as (select file, position, label, case {" ".join(whens)} else label end as harmonised from n)
 select file, cast(position as int) as position, label, harmonised, cast(row_number() over (partition by file, harmonised order by position, label) as int) as take, count(*) over (partition by file, harmonised) as n_same from h"""


@register("harmonise_labels", _labels_sql)
def q_harmonise_labels(spark, sf):
    """Headers of one file per station under the common vocabulary, with the columns that meet under one name."""
    from votepanel.sources.tables import read_table

    files = read_table(spark, sf, "supplier", ["s_suppkey"]).select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(N_COLUMNS))).alias("position"))
    label = F.get(F.array(*map(F.lit, RAW_LABELS)), ((F.col("file") * 7 + F.col("position") * 5) % len(RAW_LABELS)).cast("int"))
    return LB.harmonise_labels(files.withColumn("label", label)).select("file", "position", "label", "harmonised", "take", "n_same")


# ------------------------------------------------------------------ polygons: one for a station, two for every third one
_RINGS_SQL = """rings as (select s_suppkey, cast('Bureau ' || s_suppkey as varchar) as label, s_suppkey % 90 + 10 * r as lon, s_nationkey as lat, r as ring
 from supplier, (values (0), (1)) v(r) where r = 0 or s_suppkey % 3 = 0)"""


def polygons_table(spark, sf):
    """Station polygons written as KML placemarks and read back."""
    from votepanel.sources.geo import read_polygons
    from votepanel.sources.tables import read_table

    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])

    def polygon(shift):
        corner = [[F.format_string("%d.5,%d.25", F.col("s_suppkey") % 90 + shift + dx, F.col("s_nationkey") + dy)] for dx, dy in ((0, 0), (1, 0), (0, 1), (0, 0))]
        ring = F.concat_ws(" ", *[c for (c,) in corner])
        return F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))

    both = F.concat(F.lit("<MultiGeometry>"), polygon(0), polygon(10), F.lit("</MultiGeometry>"))
    shape = F.when(F.col("s_suppkey") % 3 == 0, both).otherwise(polygon(0))
    mark = F.concat(F.lit("<Placemark><name>Bureau "), F.col("s_suppkey").cast("string"), F.lit("</name>"), shape, F.lit("</Placemark>"))
    # a file holds a thousand stations at most, between the tags of its root
    marks = s.select(F.floor(F.col("s_suppkey") / 1000).alias("file"), F.lit(1).alias("k"), mark.alias("value"))
    tags = marks.select("file").distinct().select("file", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("value")) for k, v in ((0, "<kml>"), (2, "</kml>"))])))
    path = scratch_path(spark, "polygons") + ".kml"
    lines = marks.unionByName(tags).repartition("file").sortWithinPartitions("file", "k")
    lines.drop("k").write.partitionBy("file").text(path)
    return read_polygons(spark, path)


@register("read_polygons", "with " + _RINGS_SQL + " select label, ring, 4 as n_points, lon + 0.5::double as min_lon, lon + 1.5::double as max_lon, lat + 0.25::double as min_lat, lat + 1.25::double as max_lat from rings")
def q_read_polygons(spark, sf):
    lon, lat = F.col("points.lon"), F.col("points.lat")
    return polygons_table(spark, sf).select("label", "ring", F.size("points").alias("n_points"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"),
                                            F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"))


@register(
    "geo_bounds",
    "with " + _RINGS_SQL + """, b as (select min(lon) + 0.5::double as min_lon, min(lat) + 0.25::double as min_lat, max(lon) + 1.5::double as max_lon, max(lat) + 1.25::double as max_lat from rings)
 select *, (min_lat + max_lat) / 2 as center_lat, (min_lon + max_lon) / 2 as center_lon from b""",
)
def q_geo_bounds(spark, sf):
    from votepanel.sources.geo import geo_bounds

    return geo_bounds(polygons_table(spark, sf))


@register(
    "map_colour_table",
    "with " + _RINGS_SQL + """, st as (select '00003-' || case when s_suppkey % 2 = 0 then lpad(cast(s_suppkey as varchar), 4, '0') else lpad(cast(s_suppkey as varchar), 3, '0') end as code_bv, s_suppkey,
   case when s_acctbal > 5000 then 'centre' else 'neutral' end as colour_key from supplier where s_nationkey = 3)
 select r.label, st.code_bv, coalesce(st.colour_key, 'no_data') as colour_key from (select distinct s_suppkey, label from rings) r left join st on st.s_suppkey = r.s_suppkey""",
)
def q_map_colour_table(spark, sf):
    """Colours of the stations of one town, on the polygons of all towns; both forms of the station key occur."""
    from votepanel.sources.geo import map_colour_table
    from votepanel.sources.tables import read_table

    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).where("s_nationkey = 3")
    k = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("00003-"), F.lpad(k, F.greatest(F.length(k), F.when(F.col("s_suppkey") % 2 == 0, 4).otherwise(3)), "0"))
    return map_colour_table(polygons_table(spark, sf), s.select(code.alias("code_bv"), F.when(F.col("s_acctbal") > 5000, "centre").otherwise("neutral").alias("colour_key")), "00003")


# ------------------------------------------------------------------ display tables
# Display labels of the categories and of the extra rows.
DISPLAY_LABELS = {
    "extreme_gauche": "extrême-gauche", "gauche_dure": "gauche dure", "gauche_modere": "gauche modérée", "centre": "centre",
    "droite_modere": "droite modérée", "droite_dure": "droite dure", "extreme_droite": "extrême-droite", "blancs": "blancs",
    "nuls": "nuls", "abstention": "abstentions",
}


def display_label(c):
    m = F.create_map(*[F.lit(x) for kv in DISPLAY_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


@register(
    "display_labels",
    lambda: O.with_ctes(*O.forecast_ctes(TARGET_TYPE, TARGET_YEAR)) + """select code_bv, position, case categorie """
    + " ".join(f"when '{k}' then '{v}'" for k, v in DISPLAY_LABELS.items()) + " else categorie end as categorie, nombre from fc_alloc",
)
def q_display_labels(spark, sf):
    blocs, _ = FC._trend_parts(local_table(spark, sf), TARGET_TYPE, TARGET_YEAR)
    return blocs.select("code_bv", "position", display_label(F.col("categorie")).alias("categorie"), "nombre")


@register(
    "clean_history",
    lambda: O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES, O.FX_NAT, O.FX_EC)
    + f"""select trim(code_bv) as code_bv, lower(trim(election_type)) as election_type, election_year, coalesce(round, 1) as round, lower(trim(category)) as category,
 {O.r6('least(greatest(share, 0.0), 1.0)')} as share, {O.r6('least(greatest(share_nat, 0.0), 1.0)')} as share_nat, {O.r6('least(greatest(turnout_pct, 0.0), 1.0)')} as turnout_pct
 from fx_ec where code_bv is not null and election_type is not null and election_year is not null and category is not null""",
)
def q_clean_history(spark, sf):
    from votepanel.operators.clean import clean_history

    return round_doubles(clean_history(event_category_table(long_table(spark, sf), mapping_table(spark, sf))).select(
        "code_bv", "election_type", "election_year", "round", "category", "share", "share_nat", "turnout_pct"))


@register(
    "election_results_table",
    O.with_ctes(O.FX_LONG, O.FX_MAP, O.FX_LOCAL, O.FX_LOCAL_RATES)
    + f""", s as (select code_bv, election_type, election_year, round, category, sum(share) as share from fx_rates group by all),
 ev as (select distinct code_bv, election_type, election_year, round from fx_rates)
 select e.code_bv, e.election_type, e.election_year, e.round, c.category, {O.r6('least(greatest(coalesce(s.share, 0.0), 0.0), 1.0) * 100')} as score_pct
 from ev e cross join (values """ + ", ".join(f"('{c}')" for c in DISPLAY_ORDER) + """) c(category)
 left join s on s.code_bv = e.code_bv and s.election_type = e.election_type and s.election_year = e.election_year and s.round = e.round and s.category = c.category""",
)
def q_election_results_table(spark, sf):
    """History table of every station-election: the 7 categories (missing -> 0), share in percent."""
    loc = local_table(spark, sf)
    g = loc.groupBy("code_bv", "election_type", "election_year", "round").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "share"))).alias("_m"))
    rows = g.select("code_bv", "election_type", "election_year", "round", F.explode(F.array(*[F.lit(c) for c in DISPLAY_ORDER])).alias("category"), "_m")
    sc = F.least(F.greatest(F.coalesce(F.try_element_at("_m", F.col("category")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100
    return round_doubles(rows.select("code_bv", "election_type", "election_year", "round", "category", sc.alias("score_pct")))


@register(
    "pivot_predictions",
    lambda: O.with_ctes(*O.forecast_ctes(TARGET_TYPE, TARGET_YEAR)) + "select code_bv, "
    + ", ".join(f"{O.r6(f'max(case when categorie = {chr(39)}{c}{chr(39)} then predicted_share end)')} as {c}" for c in DISPLAY_ORDER) + " from fc_alloc group by code_bv",
)
def q_pivot_predictions(spark, sf):
    blocs, _ = FC._trend_parts(local_table(spark, sf), TARGET_TYPE, TARGET_YEAR)
    return round_doubles(pivot_category(blocs, ["code_bv"], [("", "predicted_share")], categories=DISPLAY_ORDER, agg="first", pivot_col="categorie"))


def filled_cells(df):
    """``(column_name, n)``: non-null values of every column, in one aggregation."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n")) for c in df.columns])))


@register(
    "column_matrix",
    """select column_name, max(case when t = 'lineitem' then n end) as lineitem, max(case when t = 'orders' then n end) as orders,
 max(case when t = 'customer' then n end) as customer from (
 select 'lineitem' as t, name as column_name, n from (unpivot (select count(columns(*)) from lineitem) on columns(*) into name name value n)
 union all select 'orders', name, n from (unpivot (select count(columns(*)) from orders) on columns(*) into name name value n)
 union all select 'customer', name, n from (unpivot (select count(columns(*)) from customer) on columns(*) into name name value n)) s group by column_name""",
)
def q_column_matrix(spark, sf):
    """File x column table: the filled cells of each column in each of three sources, null where the source lacks it."""
    from votepanel.sources.tables import read_table

    names = ["lineitem", "orders", "customer"]
    cells = reduce(lambda a, b: a.unionByName(b), [filled_cells(read_table(spark, sf, t)).withColumn("t", F.lit(t)) for t in names])
    return cells.groupBy("column_name").pivot("t", names).agg(F.first("n"))


# ------------------------------------------------------------------ rate choice per town and target rows
def _pick_rate_sql() -> str:
    """Every scope of every pool with the engine's own regression, then the choice."""
    rates = ("turnout_pct", "blancs_pct", "nuls_pct")

    def pool(src: str, sfx: str) -> str:
        cols = ", ".join(
            f"count({r}) as {r}_n, count(distinct case when {r} is not null then annee end) as {r}_ny, regr_slope({r}, annee) as {r}_sl, avg(case when {r} is not null then annee end) as {r}_mx, avg({r}) as {r}_my, min({r}) as {r}_min, max({r}) as {r}_max, arg_max({r}, (date_scrutin, code_bv)) filter (where {r} is not null) as {r}_last" for r in rates
        )
        return f"""{sfx}0 as (select *, max(tour = 1) over (partition by code_commune) as hr from {src}),
 {sfx}1 as (select *, max(type_scrutin = '{TARGET_TYPE}') over (partition by code_commune) as ht from {sfx}0 where not hr or tour = 1),
 {sfx} as (select code_commune, max(ht) as ht, {cols} from {sfx}1 where not ht or type_scrutin = '{TARGET_TYPE}' group by code_commune)"""

    def val(r: str, t: str) -> str:
        line = f"case when {t}.{r}_n = 0 then null when {t}.{r}_n >= 3 and {t}.{r}_ny >= 3 and {t}.{r}_sl is not null then {t}.{r}_my + {t}.{r}_sl * ({TARGET_YEAR} - {t}.{r}_mx) else {t}.{r}_last end"
        return f"least(greatest(least(greatest({line}, {t}.{r}_min), {t}.{r}_max), 0.0), 1.0)"

    measures = "max(inscrits) as inscrits, max(votants) as votants, max(blancs) as blancs, max(nuls) as nuls"
    pct = "votants/nullif(inscrits,0) as turnout_pct, blancs/nullif(inscrits,0) as blancs_pct, nuls/nullif(inscrits,0) as nuls_pct"
    out = ", ".join(O.r6(f"coalesce(case when st.ht then {val(r, 'st')} when tw.ht is not null then {val(r, 'tw')} else {val(r, 'st')} end, (select median({r}) from df where type_scrutin = '{TARGET_TYPE}'), (select median({r}) from df), 0.0)") + f" as {r}" for r in rates)
    return O.with_ctes(O.FX_LONG) + f""", be as (select code_commune, code_bv, type_scrutin, annee, tour, date_scrutin, {measures} from fx_long group by all),
 bs as (select *, {pct} from be),
 te as (select code_commune, '' as code_bv, type_scrutin, annee, tour, date_scrutin, sum(inscrits) as inscrits, sum(votants) as votants, sum(blancs) as blancs, sum(nuls) as nuls from be group by all),
 ts as (select *, {pct} from te), df as (select * from bs where tour = 1 or not (select bool_or(tour = 1) from bs)),
 {pool('bs', 'st')}, {pool('ts', 'tw')}
 select coalesce(st.code_commune, tw.code_commune) as code_commune, {out} from st full join tw on st.code_commune = tw.code_commune"""


@register("pick_rate", _pick_rate_sql)
def q_pick_rate(spark, sf):
    """Per town: projected turnout / blank / void rate from the pooled station history of the town
    (first rounds, target type when present), else the town totals, else the type default median,
    else the overall median."""
    from votepanel.plans.blocs import commune_event_stats
    from votepanel.operators.stations import bureau_event_stats, default_rates

    # The maximum totals of an event are those of its rows: the votes are computed once, and all that follows reads a row per station-event.
    totals = ("exprimes", "inscrits", "votants", "blancs", "nuls")
    keys = ("commune_code", "code_bv", "election_type", "election_year", "round", "date_scrutin")
    events = cut_lineage(long_table(spark, sf).groupBy(*keys).agg(*[F.max(c).alias(c) for c in totals]), "station_events")
    st = cut_lineage(bureau_event_stats(events).withColumn("code_commune", F.substring_index("code_bv", "-", 1)), "station_stats")
    town = cut_lineage(commune_event_stats(events, all_towns(spark, sf)), "town_stats")
    return round_doubles(FC.pick_rates(st, town, default_rates(st), TARGET_TYPE, TARGET_YEAR))


_TARGET_COLS = ["is_2020", "annee_centre", *_CAL, *_MULTI, *_ROLL, *_TREND, "y_comm_lag1", *_INTER]


def _target_rows_sql() -> str:
    ctes = []
    for c in O.model_table_sql_ctes(BASE_YEAR):
        if c.startswith("mt_base as"):
            ctes.append(c.replace("mt_base as", "mt_rule as", 1))
            ctes.append("mt_last as (select * from (select *, row_number() over (partition by code_bv, bloc order by date_scrutin desc, type_scrutin desc, tour desc) as rn from mt_rule) where rn = 1)")
            ctes.append(f"""mt_base as (select *, false as is_target from mt_rule union all by name
 select * exclude (rn) replace (make_date({TARGET_YEAR}, 3, 15) as date_scrutin, {TARGET_YEAR} as annee, '{TARGET_TYPE}' as type_scrutin, 1 as tour, null::double as part_bloc, {int(TARGET_YEAR == 2020)} as is_2020,
  {TARGET_YEAR} - (select quantile_cont(annee, 0.5) from mt_rule) as annee_centre), true as is_target from mt_last)""")
        else:
            ctes.append(c.replace("where l.part_bloc is not null", "where l.is_target"))
    return O.with_ctes(*ctes) + O.select_r6(["code_bv", "bloc", *_TARGET_COLS], set(_TARGET_COLS) - {"month", "dow", "is_2020"}, "mt_final")


@register("target_rows", _target_rows_sql)
def q_target_rows(spark, sf):
    """The last first-round row of every station x bloc moved to the target election, appended to the history, and all model
    features of the moved rows."""
    from votepanel.plans import model_table as MT

    return round_doubles(MT.target_rows(blocs_table(spark, sf), TARGET_TYPE, TARGET_YEAR).select("code_bv", "bloc", *_TARGET_COLS))


# ------------------------------------------------------------------ remaining model keys (no SQL oracle)
def _panel(spark, sf):
    from votepanel.plans.queries_ml import panel_frame

    return panel_frame(spark, sf)


# ------------------------------------------------------------------ mixed wide / long candidate files
from votepanel.operators.reshape import fill_presidential_code, unpivot_candidates_mixed  # noqa: E402
from votepanel.sources.tables import fx_wide, wide_numbers  # noqa: E402

_MIX_SQL = O.with_ctes(O.FX_LONG) + """, r as (select *, row_number() over (partition by code_bv, type_scrutin, annee, tour order by voix desc, code_candidature) as rn from fx_long)
 select code_bv, type_scrutin, annee, tour, code_candidature, voix from r where cast(right(code_bv, 4) as int) % 2 = 0
 union all select code_bv, type_scrutin, annee, tour, code_candidature, voix from fx_long where cast(right(code_bv, 4) as int) % 2 = 1"""


def mixed_table(spark, sf):
    """Even stations in wide layout (numbered columns), odd stations one row per candidate with the
    unsuffixed columns only: the shape of a file mixing both layouts."""
    even = F.substring("code_bv", -4, 4).cast("int") % 2 == 0
    w = fx_wide(spark, sf).where(even)
    numbers = wide_numbers(w)
    base = ["code_bv", "type_scrutin", "annee", "tour"]
    wide = w.select(*base, *[F.col(f"voix_{i}").alias(f"Voix {i}") for i in numbers], *[F.col(f"nuance_{i}").alias(f"Code Nuance {i}") for i in numbers],
                    F.lit(None).cast("double").alias("Voix"), F.lit(None).cast("string").alias("Code Nuance"))
    lg = fx_long(spark, sf).where(~even).select(*base, *[F.lit(None).cast("double").alias(f"Voix {i}") for i in numbers],
                                               *[F.lit(None).cast("string").alias(f"Code Nuance {i}") for i in numbers],
                                               F.col("voix").alias("Voix"), F.col("code_candidature").alias("Code Nuance"))
    return cut_lineage(wide.unionByName(lg), "mixed_layout")  # a file of mixed layout, written and read back


@register("unpivot_candidates_mixed", _MIX_SQL)
def q_unpivot_candidates_mixed(spark, sf):
    mixed = mixed_table(spark, sf)
    idx = {i: {"voix": f"Voix {i}", "code_candidature": f"Code Nuance {i}"} for i in wide_numbers(mixed)}
    out = unpivot_candidates_mixed(mixed, ["code_bv", "type_scrutin", "annee", "tour"], idx, unsuffixed={"Voix": "Voix", "Code Nuance": "Code Nuance"})
    return out.select("code_bv", "type_scrutin", "annee", "tour", "code_candidature", "voix")


@register("fill_unsuffixed", O.with_ctes(O.FX_LONG) + "select code_bv, type_scrutin, annee, tour, code_candidature, voix from fx_long where cast(right(code_bv, 4) as int) % 2 = 1")
def q_fill_unsuffixed(spark, sf):
    """Rows without numbered candidates take votes and code from the unsuffixed columns."""
    mixed = mixed_table(spark, sf)
    idx = {i: {"voix": f"Voix {i}", "code_candidature": f"Code Nuance {i}"} for i in wide_numbers(mixed)}
    out = unpivot_candidates_mixed(mixed, ["code_bv", "type_scrutin", "annee", "tour"], idx, unsuffixed={"Voix": "Voix", "Code Nuance": "Code Nuance"})
    odd = F.substring("code_bv", -4, 4).cast("int") % 2 == 1
    return out.where(odd).select("code_bv", "type_scrutin", "annee", "tour", "code_candidature", "voix")


@register(
    "candidates_long",
    O.with_ctes(O.FX_LONG) + """select code_bv, type_scrutin, annee, tour, cast(rn as integer) as cand_idx, code_candidature as raw_code, voix from (
 select *, row_number() over (partition by code_bv, type_scrutin, annee, tour order by voix desc, code_candidature) as rn from fx_long) r""",
)
def q_candidates_long(spark, sf):
    """Notebook variant: keep the candidate index and the raw code (``posexplode`` of the numbered blocks)."""
    from votepanel.operators.reshape import unpivot_numbered

    w = fx_wide(spark, sf)
    idx = {i: {"voix": f"voix_{i}", "code_candidature": f"nuance_{i}"} for i in wide_numbers(w)}
    out = unpivot_numbered(w, ["code_bv", "type_scrutin", "annee", "tour"], idx)
    return out.select("code_bv", "type_scrutin", "annee", "tour", F.col("cand_idx").cast("int").alias("cand_idx"), F.col("code_candidature").alias("raw_code"), "voix")


@register(
    "compose_name",
    """select p_partkey, coalesce(case when p_size % 4 = 0 then p_name end, case when p_size % 4 = 1 then p_brand end,
 nullif(trim(concat_ws(' ', trim(coalesce(case when p_size % 2 = 0 then split_part(p_type, ' ', 1) end, '')), trim(coalesce(case when p_size % 3 = 0 then p_brand end, '')))), '')) as nom_candidature from part""",
)
def q_compose_name(spark, sf):
    from votepanel.functions.text import compose_name
    from votepanel.sources.tables import read_table

    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    long_label = F.when(F.col("p_size") % 4 == 0, F.col("p_name"))
    short_label = F.when(F.col("p_size") % 4 == 1, F.col("p_brand"))
    first = F.when(F.col("p_size") % 2 == 0, F.split("p_type", " ")[0])
    last = F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return p.select("p_partkey", compose_name(long_label, short_label, first=first, last=last).alias("nom_candidature"))


@register(
    "fill_presidential_code",
    O.with_ctes(O.FX_LONG, O.FX_DIRTY) + """, d as (select code_bv, type_scrutin, annee, tour,
   case when upper(trim(code_candidature)) in ('NAN', 'NONE', '', '<NA>') then null else upper(trim(code_candidature)) end as code_candidature,
   'Candidat ' || cast(annee as varchar) || ' Écolo-' || right(code_bv, 2) as nom_candidature from fx_dirty)
 select code_bv, type_scrutin, annee, tour, case when type_scrutin = 'urgent' and code_candidature is null and nom_candidature is not null
   then trim(regexp_replace(upper(strip_accents(regexp_replace(nom_candidature, '[^A-Za-zÀ-ÿ ]+', ' ', 'g'))), '\\s+', ' ', 'g')) else code_candidature end as code_candidature from d""",
)
def q_fill_presidential_code(spark, sf):
    from votepanel.functions.text import normalise_code

    from votepanel.sources.tables import fx_dirty

    d = fx_dirty(spark, sf)
    d = d.withColumn("code_candidature", normalise_code("code_candidature")).withColumn(
        "nom_candidature", F.concat(F.lit("Candidat "), F.col("annee").cast("string"), F.lit(" Écolo-"), F.substring("code_bv", -2, 2)))
    return fill_presidential_code(d, presidential="urgent").select("code_bv", "type_scrutin", "annee", "tour", "code_candidature")
