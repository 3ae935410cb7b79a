"""The robust outlier estimate against a plain numpy version of the same steps."""

import random

import numpy as np
from pyspark.sql import functions as F

from votepanel.llm import outliers
from votepanel.llm.hashing import WordIds


def reference(x):
    """Squared distances of rows (whole numbers, one group) from the estimate."""
    n = len(x)

    def fit(rows):
        sums = rows.sum(axis=0).tolist()
        products = [int((rows[:, i].astype(object) * rows[:, j]).sum()) for i, j in outliers._PAIRS]
        return outliers.solve(len(rows), sums, products)

    def distance(mean, inverse):
        d = x / outliers.UNIT - mean
        return np.maximum(np.einsum("ni,ij,nj->n", d, inverse, d), 0)

    def nearest(mean, inverse):
        cell = np.floor(64 * np.log2(1 + distance(mean, inverse)))
        values, counts = np.unique(cell, return_counts=True)
        return x[cell <= values[np.searchsorted(np.cumsum(counts), outliers.SHARE * n)]]

    def low_median(v):
        return np.sort(v, axis=0)[(n + 1) // 2 - 1]

    centre = low_median(x)
    spread = low_median(np.abs(x - centre))
    starts = [(centre / outliers.UNIT, np.diag(1 / ((1.4826 * spread / outliers.UNIT) ** 2 + np.square(outliers.FLOOR)))), fit(x)[:2]]
    best = []
    for mean, inverse in starts:
        for _ in range(2):
            mean, inverse, det = fit(nearest(mean, inverse))
        best.append((det, len(best), mean, inverse))
    _, _, mean, inverse = min(best, key=lambda b: b[:2])
    for _ in range(outliers.STEPS - 2):
        mean, inverse, _ = fit(nearest(mean, inverse))
    return distance(mean, inverse)


def test_distances_equal_a_plain_version(spark):
    r = random.Random(3)
    rows = []
    for i in range(260):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(12, 200))]
        if i % 13 == 0:
            words = [w + "##" for w in words]
        if i % 9 == 0:
            words[1] += "$"
        rows.append((i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + ("\nend of file\nend of file" if i % 4 == 0 else ""), "en", "one"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {x.doc_id: x for x in outliers.quality_rules(docs).collect()}
    ids = WordIds()
    stats = spark.createDataFrame([(i, *outliers.text_stats(t, ids)) for i, t, *_ in rows], "doc_id long, " + ", ".join(f"{c} long" for c in outliers._STATS))
    sound = stats.where(~((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    numbers = sorted(tuple(x) for x in sound.select("doc_id", *outliers._numbers()).collect())
    want = reference(np.array([x[1:] for x in numbers], np.int64))
    assert len(numbers) > 200
    for (i, *_), d in zip(numbers, want, strict=True):
        assert abs(got[i].distance - d) <= 1e-6 * max(1, d) and got[i].kept == (got[i].distance <= outliers.CUTOFF)
    assert {i for i, x in got.items() if x.base_failed} == set(got) - {x[0] for x in numbers}
