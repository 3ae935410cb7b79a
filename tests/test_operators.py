"""Operator semantics on micro-fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES
from votepanel.operators import forecast as FC
from votepanel.operators import scenario as SCN
from votepanel.operators.aggregate import aggregate_event
from votepanel.operators.mapping import expand_by_category, normalise_mapping
from votepanel.operators.windows import panel_lags

LONG_SCHEMA = ("commune_code string, code_bv string, election_type string, election_year int, round int, date_scrutin date, "
               "code_candidature string, nom_candidature string, voix double, exprimes double, votants double, inscrits double, blancs double, nuls double")


def long_df(spark, rows):
    return spark.createDataFrame(rows, LONG_SCHEMA)


def mapping(spark):
    rows = [("A", "a", "gauche", None, None), ("B", "b", "centre", "droite", None), ("D", "d", "centre", "centre", None), ("E", "e", None, None, None)]
    return normalise_mapping(spark.createDataFrame(rows, "code_candidature string, nom_candidature string, bloc_1 string, bloc_2 string, bloc_3 string"))


def test_expand_split_fallbacks(spark):
    d = dt.date(2022, 4, 10)
    rows = [
        ("1", "1-1", "legislatives", 2022, 1, d, "A", None, 10.0, 40.0, 42.0, 50.0, 1.0, 1.0),
        ("1", "1-1", "legislatives", 2022, 1, d, "B", None, 10.0, 40.0, 42.0, 50.0, 1.0, 1.0),
        ("1", "1-1", "legislatives", 2022, 1, d, "D", None, 6.0, 40.0, 42.0, 50.0, 1.0, 1.0),   # same bloc twice (Q13)
        ("1", "1-1", "presidentielles", 2022, 1, d, "ZZ", "Marine Le Pen", 7.0, 40.0, 42.0, 50.0, 1.0, 1.0),  # name rule (Q12)
        ("1", "1-1", "legislatives", 2022, 1, d, "E", None, 7.0, 40.0, 42.0, 50.0, 1.0, 1.0),  # empty blocs -> centre (Q11)
    ]
    ex = expand_by_category(long_df(spark, rows), mapping(spark), broadcast=True)
    got = sorted((r.election_type, r.category, r.voix_cat) for r in ex.collect())
    assert got == sorted([
        ("legislatives", "gauche_modere", 10.0), ("legislatives", "centre", 5.0), ("legislatives", "droite_modere", 5.0),
        ("legislatives", "centre", 3.0), ("legislatives", "centre", 3.0), ("presidentielles", "extreme_droite", 7.0), ("legislatives", "centre", 7.0),
    ])


def test_aggregate_zero_valid(spark):
    d = dt.date(2020, 3, 15)
    rows = [("1", "1-1", "municipales", 2020, 1, d, "A", None, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    agg = aggregate_event(expand_by_category(long_df(spark, rows), mapping(spark), broadcast=True)).first()
    assert agg.share is None and agg.turnout_pct is None and agg.voix_cat == 5.0


def test_lags_tie_order_and_nulls(spark):
    # two types on the same date (Q14): order is date, type, round
    rows = [
        ("1-1", "gauche_modere", "departementales", 2021, 1, dt.date(2021, 6, 20), 0.2, 0.1),
        ("1-1", "gauche_modere", "regionales", 2021, 1, dt.date(2021, 6, 20), 0.3, 0.1),
        ("1-1", "gauche_modere", "legislatives", 2022, 1, dt.date(2022, 6, 12), None, 0.1),
        ("1-1", "gauche_modere", "europeennes", 2024, 1, dt.date(2024, 6, 9), 0.5, 0.1),
    ]
    df = spark.createDataFrame(rows, "code_bv string, category string, election_type string, election_year int, round int, date_scrutin date, share double, share_nat double")
    out = {r.election_type: r for r in panel_lags(df).collect()}
    assert out["regionales"].share_lag_any == 0.2
    assert out["legislatives"].share_lag_any == 0.3
    assert out["europeennes"].share_lag_any is None          # previous row is null (Q15: lag, not last non-null)
    assert out["europeennes"].share_lag2_any == 0.3
    strict = {r.election_type: r for r in panel_lags(df, strict_before=True).collect()}
    assert strict["regionales"].share_lag_any is None         # same-date rows are not visible


def test_allocate_counts_ties(spark):
    rows = [("s", i, 1 / 3, 10) for i in range(3)] + [("z", i, 0.0, 10) for i in range(3)] + [("t", i, 1 / 3, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "code_bv string, position int, share double, total long")
    out = FC.allocate_counts(df, keys=("code_bv",), share_col="share", total_col="total", order_col="position")
    got = {(r.code_bv, r.position): r["count"] for r in out.collect()}
    assert [got[("s", i)] for i in range(3)] == [4, 3, 3]       # remainder to the first position on ties (Q26)
    assert [got[("z", i)] for i in range(3)] == [0, 0, 0]
    assert [got[("t", i)] for i in range(3)] == [0, 0, 0]


def test_head_counts_half_even_and_scaling(spark):
    df = spark.createDataFrame([("s", 1001.0, 0.5, 0.3, 0.4)], "code_bv string, last_inscrits double, taux_participation double, taux_blancs double, taux_nuls double")
    r = FC.head_counts(df).first()
    # blank + void (0.7) above turnout (0.5): scaled to 0.5 in total; 1001*0.5 = 500.5 -> 500 (half-even)
    assert r.inscrits_total == 1001 and r.votants_total == 500
    assert r.blancs_total + r.nuls_total <= r.votants_total and r.exprimes_total >= 0 and r.abstention_total == 501


def test_project_share_trend_and_last(spark):
    base = ("s", "centre")
    rows = [(*base, "municipales", 2014, 1, dt.date(2014, 3, 23), 0.2), (*base, "municipales", 2020, 1, dt.date(2020, 3, 15), 0.3),
            (*base, "europeennes", 2024, 1, dt.date(2024, 6, 9), 0.9)]
    df = spark.createDataFrame(rows, "code_bv string, category string, election_type string, election_year int, round int, date_scrutin date, share double")
    r = FC.project_shares(df, "municipales", 2026).first()
    assert abs(r.raw_share - 0.4) < 1e-12                        # line through the two municipal points
    r2 = FC.project_shares(df, "presidentielles", 2027).first()
    assert 0.0 <= r2.raw_share <= 1.0


def test_transfers_chain_and_cap(spark):
    row = {f"count_{c}": 0 for c in CATEGORIES}
    row.update({"count_extreme_droite": 10, "count_droite_dure": 0, "count_centre": 5, "inscrits_total": 1000, "code_bv": "s"})
    df = spark.createDataFrame([row])
    out = SCN.apply_transfers(df, [("extreme_droite", "droite_dure", 5.0), ("droite_dure", "centre", 5.0)]).first()
    # 50 requested from 10 available: all 10 move; then those 10 move on
    assert out.count_extreme_droite == 0 and out.count_droite_dure == 0 and out.count_centre == 15


def test_share_overrides(spark):
    row = {f"share_{c}": 1 / 7 for c in CATEGORIES}
    row["code_bv"] = "s"
    df = spark.createDataFrame([row])
    below = SCN.share_overrides(df, {"centre": 50}).first()
    assert abs(sum(below[f"share_{c}"] for c in CATEGORIES) - 1) < 1e-12 and below.share_centre == 0.5
    above = SCN.share_overrides(df, {"centre": 80, "gauche_dure": 40}).first()
    assert abs(above.share_centre - 80 / 120) < 1e-12 and above.share_droite_dure == 0.0


def test_interval_swap_and_default(spark):
    wide = spark.createDataFrame([{**{f"share_{c}": 0.0 for c in CATEGORIES}, "share_centre": 0.5, "exprimes_total": 100, "code_bv": "s"}])
    res = spark.createDataFrame([("centre", 0.1, -0.2, 0.0, 0.0)], "category string, q10 double, q90 double, q05 double, q95 double")
    rows = {r.category: r for r in SCN.interval_table(wide, res).collect()}
    assert rows["centre"]["min"] == 30 and rows["centre"]["max"] == 60          # crossed bounds swapped
    assert rows["gauche_dure"]["max"] == 3 and rows["gauche_dure"]["min"] == 0  # default +-3 points, clipped
    assert rows["centre"].baseline_pct == 50.0


def test_exact_quantiles_equal_percentile(spark):
    """The bucketed quantile equals Spark's exact percentile (grouped and global); there is no other path."""
    from votepanel.operators.quantiles import exact_quantiles

    df = spark.range(0, 200_000).select((F.col("id") % 3).alias("g"), (F.sin(F.col("id")) * 1000 + F.col("id") % 97).alias("v"))
    qs = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", qs, ("g",)).collect()}
    ref = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()]).collect()}
    for g in ref:
        for n in qs:
            assert got[g][n] is not None and abs(got[g][n] - ref[g][n]) < 1e-9
    one = exact_quantiles(df, "v", {"m": 0.5}).first().m
    assert abs(one - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-9


def test_exact_quantiles_ties_and_null_groups(spark):
    """60 % ties collapse to one row, a null key is a group, a group without values is null, no rows give no result."""
    from votepanel.operators.quantiles import exact_quantiles

    df = spark.range(0, 100_000).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), F.when(F.col("id") % 10 < 6, 0.0).otherwise(F.col("id") / 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([("empty", None)], "g string, v double"))
    qs = {"p50": 0.5, "p61": 0.61, "p99": 0.99}
    got = {r.g: r for r in exact_quantiles(df, "v", qs, ("g",)).collect()}
    ref = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()]).collect()}
    assert set(got) == {"a", None, "empty"} and got["empty"].p50 is None
    assert all(abs(got[g][n] - ref[g][n]) < 1e-9 for g in ("a", None) for n in qs)
    assert exact_quantiles(df.limit(0), "v", qs).count() == 0


def test_missing_checkpoint_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from votepanel.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_last_reference_skips_null_shares(spark):
    from votepanel.plans.scoring import join_last_refs

    rows = [("s", "centre", "legislatives", 2017, 1, 0.3), ("s", "centre", "legislatives", 2022, 1, None)]
    local = spark.createDataFrame(rows, "code_bv string, category string, election_type string, election_year int, round int, share double").withColumn("date_scrutin", F.make_date("election_year", F.lit(6), F.lit(1)))
    preds = spark.createDataFrame([("s", "centre")], "code_bv string, category string")
    assert join_last_refs(preds, local, leg_type="legislatives", mun_type="municipales", mun_year=2020, target_year=2026).first().ref_leg == 0.3


def test_exact_quantiles_cut_a_large_group_into_ranges(spark, monkeypatch):
    """One group of many distinct values is no task's alone, and the values are those of one range (before: a join on the group's key)."""
    from votepanel.operators import quantiles as Q

    written = {}

    def kept(df, name="stage"):
        written[name] = cut(df, name)
        return written[name]

    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", kept)
    df = spark.range(4000).select((F.col("id") * 7919 % 4001 / 13.0).alias("v"), (F.col("id") % 40 == 0).alias("g"))
    whole = Q.exact_quantiles(df, "v", {"m": 0.5, "p": 0.99}, ("g",)).collect()
    monkeypatch.setattr(Q, "RANGE_ROWS", 100)
    ranged = Q.exact_quantiles(df, "v", {"m": 0.5, "p": 0.99}, ("g",)).collect()
    want = {r.g: (r.m, r.p) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.99).alias("p")).collect()}
    for got in (whole, ranged):
        assert {r.g for r in got} == set(want) and all(abs(r.m - want[r.g][0]) < 1e-9 and abs(r.p - want[r.g][1]) < 1e-9 for r in got)
    sizes = [r["count"] for r in written["quantile_ranges"].groupBy("_b").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 20 and max(sizes) < 800
