"""Categorical encoding, stored models, trial search and the two-stage model on small tables."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES, TARGET_COLS
from votepanel.operators import encoding as EN
from votepanel.operators import folds as FO
from votepanel.operators import gram as GR
from votepanel.operators import ml as ML
from votepanel.operators import model_store as MS
from votepanel.operators import tuning as TU

FEATURES = ["a", "b", "c"]
SCHEMA = "code_bv string, election_type string, election_year int, round int, date_scrutin date, a double, b double, c double, " + ", ".join(f"{t} double" for t in TARGET_COLS)


@pytest.fixture(scope="module")
def panel(spark):
    import datetime as dt

    r = random.Random(5)
    rows = []
    for i in range(60):
        for y in range(2000, 2005):
            x = [r.random(), r.gauss(0, 1), None if r.random() < 0.1 else r.random()]
            s = [max(0.0, x[0] - 0.4), 0.0, 0.3, *(r.random() / 9 for _ in range(4))]
            rows.append((f"s{i:02d}", "EU", y, 1, dt.date(y, 6, 1), *x, *s))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_encoding_unseen_null_and_ties(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", None), ("b", "z"), (None, "y")], "k string, t string")
    levels = EN.fit_levels(train, ["k", "t"])
    assert sorted((r.column, r.level, r.code, r.slot, r.fill) for r in levels.collect()) == [("k", "a", 0, 0, "a"), ("k", "b", 1, 1, "a"), ("t", "x", 0, 2, "x"), ("t", "y", 1, 3, "x"), ("t", "z", 2, 4, "x")]
    df = spark.createDataFrame([(1, "b", "z"), (2, None, None), (3, "new", "y"), (4, "new", "other"), (4, "a", "x")], "id int, k string, t string")
    got = sorted((r.id, r.k_code, r.t_code, r.slots) for r in EN.encode(df, levels, ["k", "t"]).collect())
    assert got == [(1, 1, 2, [1, 4]), (2, 0, 0, [0, 2]), (3, -1, 1, [3]), (4, -1, -1, []), (4, 0, 0, [0, 2])]
    vector = EN.slots_vector(EN.encode(df.where("id = 1"), levels, ["k", "t"]), 5).first().onehot
    assert vector.toArray().tolist() == [0, 1, 0, 0, 1]
    empty = EN.fit_levels(train.limit(0), ["k"])
    assert empty.count() == 0 and [(r.k_code, r.slots) for r in EN.encode(df.where("id = 1"), empty, ["k"]).collect()] == [(-1, [])]


def test_stored_pipeline_and_alignment(spark, panel, tmp_path):
    model = ML.fit_multi_output(panel, FEATURES, "gbt", {"max_iter": 2, "max_depth": 2}, targets=TARGET_COLS[:2])
    MS.save_pipeline(model, FEATURES, f"{tmp_path}/m")
    back, names = MS.load_pipeline(spark, f"{tmp_path}/m")
    assert names == FEATURES
    keys = ["code_bv", "election_year"]
    preds = [f"pred_{c}" for c in CATEGORIES[:2]]
    want = sorted(map(tuple, model.transform(panel).select(*keys, *preds).collect()))
    shuffled = panel.select("c", F.lit(1).alias("extra"), "b", *keys, F.col("a").cast("string").alias("a"))
    assert sorted(map(tuple, back.transform(MS.align(shuffled, names, keys)).select(*keys, *preds).collect())) == want
    aligned = MS.align(panel.drop("b"), names, [*keys, "not there"])
    assert aligned.columns == [*keys, *FEATURES] and aligned.where("b is not null").count() == 0
    assert back.transform(aligned).select(*preds).count() == panel.count()


def test_stored_ridge(spark, panel, tmp_path):
    train = GR.whole_set(panel, "m", F.lit(True))
    models = GR.fit_ridge(GR.event_statistics(panel, FEATURES), train, FEATURES)
    MS.save_ridge(models, FEATURES, f"{tmp_path}/r")
    back, names = MS.load_ridge(spark, f"{tmp_path}/r")
    rows = panel.withColumn("model", F.lit("m"))
    a, b = (sorted(map(tuple, GR.score_ridge(rows, m, names).select("code_bv", "election_year", "pred_centre").collect())) for m in (models, back))
    assert a == b


def test_search_is_seeded_and_keeps_failures(spark, panel):
    grids = {"ridge": [{"alpha": 0.1}, {"alpha": -1.0}], "gbt": [{"max_iter": 1, "max_depth": 1}] * 7}
    declared = TU.declared_trials(spark, grids)
    draws = [sorted((r.model, r.setting) for r in TU.draw_trials(declared, 3, seed).collect()) for seed in (1, 1, 2)]
    assert draws[0] == draws[1] and len(draws[0]) == 5 and draws[0] != draws[2]
    assert TU.draw_trials(declared).count() == 9
    calls = []

    def fit(train, features, kind, params):
        calls.append(train.select("fold").distinct().count())
        if len(calls) == 2:
            raise RuntimeError("out of luck")
        return Pipeline(stages=ML.preprocessor(features) + [ML.make_regressor("ridge", {}, features_col="features", label_col=t, prediction_col=t.replace("target_share", "pred")) for t in TARGET_COLS]).fit(train)

    trials = declared.where("model = 'ridge' or setting = 0")
    got = TU.run_trials(panel, FO.event_folds(FO.event_table(panel), 2), trials, FEATURES, fit).collect()
    status = sorted((r.model, r.setting, r.fold, r.status) for r in got)
    assert status == [("gbt", 0, 0, "ok"), ("gbt", 0, 1, "failed"), ("ridge", 0, 0, "ok"), ("ridge", 0, 1, "ok"), ("ridge", 1, 0, "failed"), ("ridge", 1, 1, "failed")]
    assert calls == [1, 1] and all((r.error is None) == (r.mae_mean is not None) == (r.status == "ok") for r in got)
    best = ML.select_best(TU.summarise_trials(spark.createDataFrame(got, TU.RESULT))).collect()
    assert [(r.model, r.setting, r.n_folds) for r in best] == [("ridge", 0, 2)]


def test_rows_of_a_fold_are_prepared_once_for_all_trials(spark, panel, monkeypatch):
    prepared, stages = [], ML.preprocessor
    monkeypatch.setattr(ML, "preprocessor", lambda features, **more: prepared.append(1) or stages(features, **more))
    grid = [{"max_iter": 2, "max_depth": 2}, {"max_iter": 1, "max_depth": 3, "loss": "no such loss"}, {"max_iter": 3, "max_depth": 1, "learning_rate": 0.5}]
    folds = FO.event_folds(FO.event_table(panel), 2)
    got = {(r.setting, r.fold): r for r in TU.run_trials(panel, folds, TU.declared_trials(spark, {"gbt": grid}), FEATURES).collect()}
    assert len(prepared) == 2 and {k: r.status for k, r in got.items()} == {(s, f): "failed" if s == 1 else "ok" for s in range(3) for f in range(2)}
    rows = FO.assign_folds(panel, folds).cache()
    for (setting, fold), r in got.items():  # as each trial on its own has it
        if r.status == "ok":
            mine = rows.where(F.col("fold") == fold)
            model = ML.fit_multi_output(mine.where("role = 'train'"), FEATURES, "gbt", grid[setting])
            alone = TU.ME.regression_metrics(ML.predictions_long(model.transform(mine.where("role = 'test'")), keep=("fold",)), ("fold",)).first()
            assert all(abs(r[m] - alone[m]) < 1e-9 for m in TU.METRICS)
    monkeypatch.setattr(ML, "ROWS_AT_ONCE", 1)  # one after the other
    again = {(r.setting, r.fold): r.mae_mean for r in TU.run_trials(panel, folds, TU.declared_trials(spark, {"gbt": grid[:1]}), FEATURES).collect()}
    assert all(abs(again[0, f] - got[0, f].mae_mean) < 1e-9 for f in range(2))


def test_grid_search_runs_every_declared_setting(spark, panel, monkeypatch):
    import json

    from votepanel.plans import queries_ridge as QR

    seen = []
    monkeypatch.setattr(QR, "panel_frame", lambda spark, sf: panel)
    monkeypatch.setattr(QR.TU, "run_trials", lambda panel, folds, trials, features: seen.extend(trials.collect()) or spark.createDataFrame([], TU.RESULT))
    QR.q_grid_search(spark, "")
    got = {(r.model, r.setting): json.loads(r.params) for r in seen}
    assert got == {(m, i): g for m, grid in (("ridge", TU.RIDGE_GRID), ("gbt", TU.BOOSTING_GRID)) for i, g in enumerate(grid)}


@pytest.mark.parametrize("proba,logit,classifier", [(True, True, "gbt"), (False, True, "logistic"), (True, False, "gbt")])
def test_two_stage_options_and_constant_classes(spark, panel, proba, logit, classifier):
    train, test = panel.where("election_year < 2004"), panel.where("election_year = 2004")
    got = ML.two_stage(train, test, FEATURES, use_proba=proba, use_logit=logit, classifier=classifier, params={"max_iter": 3, "max_depth": 2}).collect()
    assert len(got) == 60 * 7
    by = {c: [r for r in got if r.category == c] for c in CATEGORIES}
    hurdle, never, always = (by[c] for c in CATEGORIES[:3])
    assert all(r.proba == 0 and r.value == 0 and r.prediction == 0 for r in never)
    assert all(r.proba == 1 and abs(r.prediction - 0.3) < 1e-6 for r in always)
    for r in hurdle:
        assert 0 <= r.proba <= 1 and 0 <= r.value <= 1
        assert abs(r.prediction - (r.proba * r.value if proba else r.value * (r.proba >= 0.5))) < 1e-12
    error = sum(abs(r.prediction - r.y_true) for r in hurdle) / 60
    mean = sum(r.y_true for r in hurdle) / 60
    assert error < sum(abs(mean - r.y_true) for r in hurdle) / 60  # better than a constant
