"""Fold arithmetic on small event tables, model sanity against the naive predictor, streaming ingest."""

import datetime as dt

from pyspark.sql import functions as F

from votepanel.operators import folds as FO


def events(spark, n):
    return spark.createDataFrame([(f"e{i:02d}", dt.date(2000 + i, 1, 1)) for i in range(n)], "event_key string, date_scrutin date")


def roles(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.fold, {}).setdefault(r.role, []).append(int(r.event_key[1:]))
    return {f: {k: sorted(v) for k, v in d.items()} for f, d in out.items()}


def test_event_folds_expanding(spark):
    r = roles(FO.event_folds(events(spark, 5), 4))
    assert r == {i: {"train": list(range(i + 1)), "test": [i + 1]} for i in range(4)}
    assert roles(FO.event_folds(events(spark, 2), 4)) == {0: {"train": [0], "test": [1]}}
    r9 = roles(FO.event_folds(events(spark, 9), 4))
    assert [r9[i]["test"] for i in range(4)] == [[5], [6], [7], [8]] and r9[0]["train"] == [0, 1, 2, 3, 4]


def test_cut_folds(spark):
    r = roles(FO.cut_folds(events(spark, 5), 4))
    assert [r[k]["test"] for k in (1, 2, 3, 4)] == [[3], [3], [4], [4]]
    assert r[1]["train"] == [0, 1, 2]


def test_ridge_beats_nothing_and_is_deterministic(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    a = E.queries()["ridge"](spark, sf).first()
    b = E.queries()["ridge"](spark, sf).first()
    assert a.mae_mean == b.mae_mean                                   # same data, same fit
    naive = E.queries()["regression_metrics"](spark, sf).first()
    assert 0 <= a.mae_mean < 1 and a.mae_mean <= max(naive.mae_mean * 2, 0.2)   # bounded against the naive last value


def test_stream_ingest_matches_batch(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    s = E.queries()["stream_ingest"](spark, sf)
    b = E.queries()["ingest_catalog"](spark, sf)
    assert s.count() == b.count() and s.exceptAll(b).count() == 0
