"""Trend statistics from sums per year against a direct line, and the plan they give."""

import contextlib
import io
import random

import numpy as np
from pyspark.sql import functions as F

from votepanel.operators import forecast as FC


def test_line_from_sums_per_year(spark):
    r = random.Random(4)
    rows = [(f"s{i % 7}", y, i, r.choice([None, r.random(), 0.5])) for i, y in enumerate(r.choice([None, *range(1995, 2003)]) for _ in range(300))]
    rows += [("one", 2000, 1, 0.3), ("one", 2000, 2, 0.5), ("none", 1999, 1, None)]
    df = spark.createDataFrame(rows, "k string, election_year int, no int, v double").repartition(5)
    got = {x.k: x for x in FC.trend_statistics(df, ("k",), {"v": F.col("v")}, F.col("no"), latest={"any": F.col("v")}).collect()}
    assert set(got) == {k for k, *_ in rows}
    for k, x in got.items():
        mine = sorted((no, y, v) for g, y, no, v in rows if g == k and y is not None and v is not None)
        every = sorted((no, v) for g, _, no, v in rows if g == k and v is not None)
        assert x["any"] == (every[-1][1] if every else None)
        assert (x.v_n, x.v_ny) == (len(mine), len({y for _, y, _ in mine}))
        if mine:
            ys, vs = np.array([m[1] for m in mine], float), np.array([m[2] for m in mine])
            assert (x.v_last, x.v_min, x.v_max) == (vs[-1], vs.min(), vs.max())
            if x.v_ny > 1:
                assert np.isclose(x.v_slope, np.polyfit(ys, vs, 1)[0]) and np.isclose(x.v_my + x.v_slope * (2010 - x.v_mx), np.polyval(np.polyfit(ys - 2000, vs, 1), 10))
            else:
                assert x.v_slope is None
        else:
            assert x.v_last is None and x.v_my is None


def test_rates_are_hash_aggregates(spark):
    df = spark.createDataFrame([("a", "low", 2000 + i, 1, None, 0.5, 0.1, 0.1, 10.0) for i in range(5)], "code_bv string, election_type string, election_year int, round int, date_scrutin date, taux_participation double, taux_blancs double, taux_nuls double, inscrits double")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        FC.project_rates(df, "low", 2010).explain()
    plan = out.getvalue()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1
