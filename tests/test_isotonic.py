"""Isotonic calibration against the definition: max over starts of min over ends of the mean between."""

import random

import numpy as np
import pytest

from votepanel.operators import isotonic as ISO


def direct(points):
    """points: sorted (x, w, wy) -> isotonic value per x by the max-min formula."""
    w = np.cumsum([0, *(p[1] for p in points)])
    s = np.cumsum([0, *(p[2] for p in points)])
    n = len(points)
    return [max(min((s[k + 1] - s[j]) / (w[k + 1] - w[j]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def fixture(seed, n=150):
    r = random.Random(seed)
    return [(r.choice("ab"), p := round(r.random(), 2), max(0.0, p * p + r.gauss(0, 0.2)), r.choice([0.5, 1.0, 3.0])) for _ in range(n)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_calibrate_equals_definition(spark, weight):
    rows = fixture(1) + [("a", None, 0.5, 1.0), ("a", 0.4, None, 1.0), ("b", 0.5, 9.0, 0.0), ("few", 0.2, 0.9, 1.0), ("b", 1.7, 1.0, 1.0), ("b", -0.2, 0.0, 1.0)]
    if weight is None:
        rows = [x for x in rows if x[3]]
    fitted = spark.createDataFrame(rows, "category string, y_pred double, y_true double, w double").repartition(4)
    asked = [("a", x / 250) for x in range(-5, 260)] + [("b", x / 250) for x in range(-5, 260)] + [("few", 0.7), ("none", 0.3), ("a", None)] * 2
    scored = spark.createDataFrame([(*x, i) for i, x in enumerate(asked)], "category string, y_pred double, id int")
    got = {r.id: r for r in ISO.calibrate(fitted, scored, ("category",), weight=weight).collect()}
    assert len(got) == len(asked)
    for g in "ab":
        points = {}
        for c, x, y, w in rows:
            if c == g and x is not None and y is not None and w > 0:
                p = points.setdefault(min(max(x, 0), 1), [0, 0])
                w = w if weight else 1.0
                p[0] += w
                p[1] += w * y
        xs = sorted(points)
        ys = direct([(x, *points[x]) for x in xs])
        for i, (c, x) in enumerate(asked):
            if c == g and x is not None:
                assert abs(got[i].y_cal - np.interp(min(max(x, 0), 1), xs, ys)) < 1e-9
    assert all(got[i].y_cal == x for i, (c, x) in enumerate(asked) if c in ("few", "none") or x is None)


def test_pooling_in_parts_is_pooling_at_once():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 40)
        points = [[i, i, r.choice([1.0, 2.0]), float(r.randrange(-3, 4)), 1] for i in range(n)]
        once, parts = [], []
        for p in points:
            ISO.pool(once, list(p))
        cuts = sorted(r.randrange(n) for _ in range(3))
        for a, b in zip([0, *cuts], [*cuts, n]):
            part = []
            for p in points[a:b]:
                ISO.pool(part, list(p))
            parts += part
        whole = []
        for p in parts:
            ISO.pool(whole, p)
        assert whole == once
        means = [b[3] / b[2] for b in once]
        assert all(x < y for x, y in zip(means, means[1:]))


def test_empty(spark):
    none = spark.createDataFrame([], "category string, y_pred double, y_true double")
    scored = spark.createDataFrame([("a", 0.25, 0.5)], "category string, y_pred double, y_true double")
    assert ISO.calibrate(none, none, ("category",)).count() == 0
    assert ISO.calibrate(none, scored).first().y_cal == 0.25
