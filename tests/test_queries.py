"""Every registered query runs on sf0.001; a sample is compared with its DuckDB oracle."""

import math
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE_SAMPLE = ["build_panel", "expand_by_category", "trend_forecast", "score_features", "regression_metrics", "station_features",
                 "ingest_catalog", "history_star_join", "event_folds", "blend_type_history"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        if hasattr(v, "isoformat"):
            return str(v)[:19]
        return v

    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 100
    assert set(o) <= set(q)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target_share_centre" in df.columns


@pytest.mark.parametrize("key", ORACLE_SAMPLE)
def test_oracle_match(spark, key):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    df = E.queries()[key](spark, SF)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)


def test_sample_rows_brute_force(spark):
    """Seeded sample = the n keys with the smallest seeded hash (checked by sorting everything)."""
    from pyspark.sql import functions as F

    df = E.queries()["sample_rows"](spark, SF)
    keys = [r[0] for r in df.collect()]
    allk = E.queries()["distinct_stations"](spark, SF).select("code_bv", F.md5(F.concat(F.col("code_bv"), F.lit(":42"))).alias("h")).collect()
    expected = [r[0] for r in sorted(allk, key=lambda r: (r[1], r[0]))][: len(keys)]
    assert keys == expected and len(keys) == min(20, len(allk))
