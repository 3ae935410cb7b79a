"""Ridge from sums per election against Spark ML and against direct fits."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from votepanel.operators import gram as GR

FEATURES, TARGETS = ["f0", "f1", "f2", "flat"], ["target_share_a", "target_share_b"]
SCHEMA = "code_bv string, election_type string, election_year int, round int, f0 double, f1 double, f2 double, flat double, target_share_a double, target_share_b double, w double"


def rows(n=400):
    r = random.Random(3)
    out = []
    for i in range(n):
        x = [r.gauss(0.2, 0.1), r.gauss(0, 0.3), r.random()]
        y = 0.3 * x[0] - 0.1 * x[1] + r.gauss(0, 0.05)
        x = [None if r.random() < 0.2 else v for v in x]
        out.append((f"s{i}", r.choice(["EU", "mun "]), 2000 + i % 4, 1, *x, 0.5, y, 0.2 - y / 2 + r.gauss(0, 0.01), float(r.randrange(1, 9))))
    return out


def sets(df, condition):
    return df.where(condition).select(F.lit("m").alias("model"), GR.event_key().alias("event_key")).distinct()


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_equals_spark_ml(spark, alpha):
    panel = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    train = sets(panel, "election_year < 2003")
    model = GR.fit_ridge(GR.event_statistics(panel, FEATURES[:3], TARGETS), train, FEATURES[:3], TARGETS, [alpha])
    fill = model.first().fill
    filled = panel.fillna(dict(zip(FEATURES[:3], fill, strict=True)))
    part = filled.where("election_year < 2003")
    raw = VectorAssembler(inputCols=FEATURES[:3], outputCol="raw")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="x").fit(raw.transform(part))
    n = part.count()
    got = GR.score_ridge(panel.withColumn("model", F.lit("m")), model, FEATURES[:3], TARGETS)
    for t in TARGETS:
        # Spark ML divides its penalty by the standard deviation of the label
        spread = part.agg(F.stddev_pop(t)).first()[0]
        fit = LinearRegression(regParam=alpha / n * spread, elasticNetParam=0.0, standardization=False, solver="normal", featuresCol="x", labelCol=t).fit(scaler.transform(raw.transform(part)))
        want = {r.code_bv: r.prediction for r in fit.transform(scaler.transform(raw.transform(filled))).select("code_bv", "prediction").collect()}
        for r in got.select("code_bv", F.col(f"pred_{t[-1]}").alias("p")).collect():
            assert abs(r.p - want[r.code_bv]) < 1e-6


def test_weights_folds_and_odd_sets(spark):
    data = rows()
    data[0] = (*data[0][:8], None, 0.1, 1.0)  # no target
    data[1] = (*data[1][:10], 0.0)  # no weight
    data[2] = (*data[2][:10], None)
    panel = spark.createDataFrame(data, SCHEMA)
    stats = GR.event_statistics(panel, FEATURES, TARGETS, weight="w")
    keys = panel.select("election_year", GR.event_key().alias("event_key")).distinct()
    training = keys.select(F.explode(F.array(*[F.when(F.col("election_year") != y, F.lit(y)) for y in range(2000, 2004)])).alias("model"), "event_key").where("model is not null")
    training = training.unionByName(spark.createDataFrame([(9999, "none|1|1")], "model int, event_key string"))
    models = {r.model: r for r in GR.fit_ridge(stats, training, FEATURES, TARGETS, [2.0]).collect()}
    assert set(models) == {2000, 2001, 2002, 2003}  # a set without rows has no model
    for year, m in models.items():
        mine = [d for d in data if d[2] != year and d[8] is not None and d[10] and d[10] > 0]
        x = np.array([d[4:8] for d in mine], float)
        cell = [np.sort(np.floor(c[~np.isnan(c)] * GR.GRID))[(np.count_nonzero(~np.isnan(c)) - 1) // 2] for c in x.T]
        fill = (np.array(cell) + 0.5) / GR.GRID
        assert np.allclose(m.fill, fill)
        x = np.where(np.isnan(x), fill, x)[:, :3]
        y, w = np.array([d[8:10] for d in mine], float), np.array([d[10] for d in mine])
        mean = w @ x / w.sum()
        sd = np.sqrt((w @ (x - mean) ** 2) / (w.sum() - 1))
        z = (x - mean) / sd
        coef = np.linalg.solve(z.T @ (z * w[:, None]) + 2 * np.eye(3), z.T @ ((y - w @ y / w.sum()) * w[:, None])).T / sd
        assert np.allclose(np.array(m.coef)[:, :3], coef) and np.all(np.array(m.coef)[:, 3] == 0)  # the flat feature is dropped
        assert np.allclose(m.intercept, w @ y / w.sum() - coef @ mean)


def test_sums_do_not_depend_on_partitions_and_empty_panel(spark):
    panel = spark.createDataFrame(rows(), SCHEMA)
    train = sets(panel, "election_year < 2003")
    a, b = (GR.fit_ridge(GR.event_statistics(panel.repartition(k), FEATURES, TARGETS), train, FEATURES, TARGETS).first() for k in (1, 7))
    assert a.n == b.n and np.allclose(a.coef, b.coef, atol=1e-12) and a.fill == b.fill
    empty = panel.limit(0)
    assert GR.fit_ridge(GR.event_statistics(empty, FEATURES, TARGETS), train, FEATURES, TARGETS).count() == 0


def test_a_task_hands_on_one_matrix_an_election(monkeypatch):
    """Batches of a task are summed before they leave it (before: a matrix a batch and election), whole also where the cells held are few."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    n = 600
    x = r.random((n, 2))
    x[::7, 0] = np.nan
    table = pa.RecordBatch.from_arrays([pa.array([f"e{i % 3}" for i in range(n)]), pa.array(np.ones(n)), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(r.random(n))], names=["event_key", "_w", "_x0", "_x1", "_x2"])

    def sums(size):
        got, out = {}, list(GR._sums(2, 1)(iter([table.slice(k, size) for k in range(0, n, size)])))
        rows = 0
        for b in out:
            for e, j, c, v in zip(*(col.to_pylist() for col in b.columns), strict=True):
                got[e, j, c] = got.get((e, j, c), 0.0) + v
                rows += j < 0
        return got, rows

    whole, rows = sums(n)
    parts, rows_of_parts = sums(50)
    assert rows == rows_of_parts == 3 * 21
    monkeypatch.setattr(GR, "HELD_CELLS", 200)
    flushed, rows_flushed = sums(50)
    assert rows_flushed > rows
    for other in (parts, flushed):
        assert other.keys() == whole.keys() and all(abs(other[k] - whole[k]) < 1e-9 for k in whole)
    assert sum(v for (e, j, c), v in whole.items() if j == 0) == n - len(range(0, n, 7))
