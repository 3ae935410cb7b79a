"""What a task holds and how often a table is computed, on rows of the tests' own."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES, TARGET_COLS
from votepanel.operators import folds as FO
from votepanel.operators import quantiles as Q
from votepanel.operators import tuning as TU
from votepanel.operators.aggregate import aggregate_event
from votepanel.operators.clean import prepare_long
from votepanel.operators.mapping import expand_by_category, normalise_mapping
from votepanel.plans import model_table as MT
from votepanel.plans import panel as P
from votepanel.session import task_number
from votepanel.sources import tables as T


def test_partitions_of_the_station_windows_follow_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert task_number(spark, 10, 200_000) == cores and task_number(spark, 200_000 * 5000, 200_000) == 5000
    rows = [("1", f"s{i}", "EU", 2000, 1, dt.date(2000, 6, 1), c, None, 5.0, 10.0, 12.0, 20.0, 1.0, 1.0) for i in range(30) for c in ("A", "B")]
    long_df = spark.createDataFrame(rows, "commune_code string, code_bv string, election_type string, election_year int, round int, date_scrutin date, code_candidature string, nom_candidature string, voix double, exprimes double, votants double, inscrits double, blancs double, nuls double")
    mapping = spark.createDataFrame([("A", "a", CATEGORIES[0], None, None), ("B", "b", CATEGORIES[1], None, None)], "code_candidature string, nom_candidature string, bloc_1 string, bloc_2 string, bloc_3 string")
    monkeypatch.setattr(P, "ROWS_A_TASK", 2)
    out = P.event_category_table(long_df, mapping, broadcast=True)
    assert out.rdd.getNumPartitions() == max(cores, 30) and out.count() == 60 and out.where("share = 0.5 and share_nat = 0.5").count() == 60


def test_target_rows_read_base_rows_written_once(spark):
    rows = [("00001", f"00001-{s}", CATEGORIES[0], "low", 1, 1990 + y, dt.date(1990 + y, 3, 1), 0.1 * s + 0.01 * y, 0.5, 0.0, 5.0, 10.0, 20.0, 12.0, float(y)) for s in range(3) for y in range(4)]
    blocs = spark.createDataFrame(rows, "code_commune string, code_bv string, bloc string, type_scrutin string, tour int, annee int, date_scrutin date, part_bloc double, taux_participation_bv double, ecart_bloc_vs_national double, voix_bloc double, exprimes double, inscrits double, votants double, annee_centre double")
    out = MT.target_rows(blocs, "low", 2002)
    assert out.inputFiles() and all("/base_rows-" in f for f in out.inputFiles())
    got = {r.code_bv: (round(r.part_bloc_lag1, 9), r.annee_centre) for r in out.collect()}
    assert got == {f"00001-{s}": (round(0.1 * s + 0.03, 9), 2002 - 1991.5) for s in range(3)}


def test_ridge_trials_share_one_pass(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"s{i}", "EU", y, 1, dt.date(y, 6, 1), r.random(), *(r.random() / 7 for _ in CATEGORIES)) for y in range(2000, 2006) for i in range(12)]
    panel = spark.createDataFrame(rows, "code_bv string, election_type string, election_year int, round int, date_scrutin date, a double, " + ", ".join(f"{t} double" for t in TARGET_COLS))
    passes, metrics = [], TU.ME.regression_metrics
    monkeypatch.setattr(TU.ME, "regression_metrics", lambda diag, by: passes.append(by) or metrics(diag, by))
    folds = FO.event_folds(FO.event_table(panel), 2)

    def run(*alphas):
        return {(x.params, x.fold): (x.status, x.mae_mean, x.medae) for x in TU.run_trials(panel, folds, TU.declared_trials(spark, {"ridge": [{"alpha": a} for a in alphas]}), ["a"]).collect()}

    together = run(0.1, -1.0, 5.0)
    assert len(passes) == 1 and len(together) == 6 and sum(s == "failed" for s, *_ in together.values()) == 2
    for key, (status, mae, med) in run(5.0).items():
        assert together[key][0] == status == "ok" and abs(together[key][1] - mae) < 1e-12 and abs(together[key][2] - med) < 1e-12


def exchanges(df):
    """Columns and partitions of the hash exchanges of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_no_exchange_of_the_panel_has_the_sessions_partitions(spark, tmp_path, monkeypatch):
    n = 40
    tables = {
        "lineitem": ([(i, i % 5, i % 7, float(i % 9 + 1), "RAN"[i % 3]) for i in range(n)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
        "orders": ([(i, "OF"[i % 2], dt.date(1995 + i % 2, 1, 1), "1-URGENT") for i in range(n)], "o_orderkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"),
        "supplier": ([(i, i % 2) for i in range(7)], "s_suppkey long, s_nationkey int"),
        "part": ([(i, f"Brand#{i + 11}") for i in range(5)], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    expected = sorted(map(str, P.build_panel(prepare_long(T.fx_long(spark, str(tmp_path))), normalise_mapping(T.fx_mapping(spark, str(tmp_path)))).collect()))
    many = spark.sparkContext.defaultParallelism + 5
    monkeypatch.setattr(T, "LINES_A_TASK", -(-n // many))
    monkeypatch.setattr(P, "ROWS_A_TASK", 1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        long_df = prepare_long(T.fx_long(spark, str(tmp_path)))
        mapping = normalise_mapping(T.fx_mapping(spark, str(tmp_path)))
        tasks = T.task_number(spark, n, T.LINES_A_TASK)
        found = exchanges(long_df)
        assert tasks > spark.sparkContext.defaultParallelism and len(found) >= 5 and {int(k) for _, k in found} == {tasks}
        by_category = aggregate_event(expand_by_category(long_df, mapping, broadcast=True))
        assert [x for x in exchanges(by_category) if "category" in x[0]] == []  # it stands in the tasks of the long table
        panel = P.build_panel(long_df, mapping)
        stations = [(c, int(k)) for c, k in exchanges(panel) if "code_bv" in c]
        assert len(stations) == 1 and stations[0][1] > tasks
        assert sorted(map(str, panel.collect())) == expected and expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ranges_of_quantiles_follow_the_rows(spark, monkeypatch):
    """No exchange of the values has the session's partitions, and rows of one value are more than one task's."""
    plans, written, cut = {}, {}, Q.cut_lineage

    def kept(df, name="stage"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        written[name] = cut(df, name)
        return written[name]

    monkeypatch.setattr(Q, "cut_lineage", kept)
    monkeypatch.setattr(Q, "RANGE_ROWS", 100)
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 7, 0.0).otherwise(F.col("id") * 7919 % 4001 / 13.0).alias("v"), (F.col("id") % 4 == 0).alias("g"))
    df = df.unionByName(spark.createDataFrame([(None, True), (float("nan"), False), (-0.0, True)], "v double, g boolean"))
    found = Q.exact_quantiles(df, "v", {"low": 0.5, "mid": 0.8, "high": 0.97}, ("g",))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.g: (r.low, r.mid, r.high) for r in found.collect()}
    want = {r.g: (r.low, r.mid, r.high) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("low"), F.percentile("v", 0.8).alias("mid"), F.percentile("v", 0.97).alias("high")).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for g in want for a, b in zip(got[g], want[g], strict=True))
    values = [p for p in plans.values() if "_x" in p]
    assert not any(re.search(r"hashpartitioning\([^)]*_x", p) for p in values)
    assert re.findall(r"rangepartitioning\([^)]*, (\d+)\)", plans["quantile_ranges"]) == ["41"]
    sizes = [r.n for r in written["quantile_ranges"].groupBy("_b").agg(F.sum("_n").alias("n")).collect()]
    assert sum(sizes) == 4002 and len(sizes) > 20 and max(sizes) < 800


def test_pick_rate_computes_the_votes_once(spark, monkeypatch):
    from votepanel.operators import forecast as FC
    from votepanel.operators import stations as ST
    from votepanel.plans import blocs as B
    from votepanel.plans import queries_extra as QX

    r = random.Random(8)
    rows = []
    for town in ("00001", "00002", None):
        for s in range(4):
            for y in range(1995, 2001):
                kind, tour = r.choice(["low", "high", None]), r.choice([1, 1, 2, None])
                ins = r.choice([0.0, 200.0, None])
                for c in "AB":  # a total may be missing in one of an event's rows
                    rows.append((town, f"{town}-{s:04d}" if town else None, kind, y, tour, dt.date(y, 3, 1), c, 5.0, 60.0, r.choice([90.0 + s, None]), ins, 2.0, r.choice([None, 3.0])))
    schema = "commune_code string, code_bv string, election_type string, election_year int, round int, date_scrutin date, code_candidature string, voix double, exprimes double, votants double, inscrits double, blancs double, nuls double"
    plain, towns = spark.createDataFrame(rows, schema), spark.createDataFrame([("00001", "A"), ("00002", "B")], "code_commune string, nom_commune string")
    st = ST.bureau_event_stats(plain).withColumn("code_commune", F.substring_index("code_bv", "-", 1))
    want = FC.pick_rates(st, B.commune_event_stats(plain, towns), ST.default_rates(st), QX.TARGET_TYPE, QX.TARGET_YEAR)
    computed = spark.sparkContext.accumulator(0)

    def seen(v):
        computed.add(1)
        return v

    monkeypatch.setattr(QX, "long_table", lambda spark, sf: plain.withColumn("code_bv", F.udf(seen, "string").asNondeterministic()("code_bv")))
    monkeypatch.setattr(QX, "all_towns", lambda spark, sf: towns)
    got = QX.q_pick_rate(spark, "").collect()
    assert computed.value == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, QX.round_doubles(want).collect())) and len(got) == 2


def test_rows_are_dealt_by_station_without_labels(spark, tmp_path):
    """The last exchange of the long table carries no town, type or date: they are made after it."""
    tables = {
        "lineitem": ([(i, i % 3, i % 2, float(i + 1), ["R", "A", "N", None][i % 4]) for i in range(12)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
        "orders": ([(i, [None, "O"][i % 2], dt.date(1995, 1, 1), "1-URGENT") for i in range(12)], "o_orderkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"),
        "supplier": ([(0, 7), (1, 123456), (1, 123456)], "s_suppkey long, s_nationkey int"),
        "part": ([(i, "Brand#11") for i in range(3)], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    long_df = T.fx_long(spark, str(tmp_path))
    plan = long_df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression [code_bv"):]
    assert "make_date" in plan and "make_date" not in below and "lower(" not in below
    got = {(r.code_commune, r.code_bv, r.tour, r.voix, r.exprimes, r.blancs, r.nuls, r.inscrits) for r in long_df.collect()}
    # a supplier that comes twice has its rows twice, and its totals are of both
    assert got == {("00007", "00007-0000", 1, 36.0, 36.0, 3.0, 0.0, 99.0), ("12345", "12345-0001", 2, 42.0, 84.0, 0.0, 6.0, 210.0)} and long_df.count() == 3
