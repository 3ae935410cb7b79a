"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 toxic, 1 of low quality, 2 good. One weight vector over hashed tokens is shared by all grades, and
ordered thresholds cut its score: P(grade <= k) = logistic(threshold_k - score). A text's features are its distinct tokens (lower-cased
runs of letters and digits, and runs of other signs), hashed to 2^18 places. The fit takes at most SAMPLE rows of each grade, those
with the smallest hash of doc_id, weighted back to the labelled rows they stand for; scoring covers every row. Only places whose share
of texts differs clearly between grades (telling_places) get a weight, so rare words add no noise; weights count against a
text only, so a short clean text is not rejected for lack of evidence.

Selection keeps a text whose probability of the top grade is at least ``keep_at``.

Defined results: null or empty text has no feature and is graded by the thresholds alone; labels with null doc_id, quality and toxic are
ignored, of several labels of a document the worst counts; without labelled rows of two grades nothing is fitted: grades are
null and all rows are kept; repeated rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRADES, PLACES, SAMPLE, MIN_ROWS, TELLING = 3, 1 << 18, 4000, 8, 4.5
#: Rounds of the fit, its step size and the pull of weights towards 0.
ROUNDS, STEP, RIDGE = 150, 0.15, 2e-4
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall


class Places(dict):
    """Token -> hashed place; remembered up to a limit."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        place = self[token] = xxhash.xxh3_64_intdigest(token) & (PLACES - 1)
        return place

    def of(self, text: str) -> np.ndarray:
        tokens = set(_TOKEN(text.lower()))
        return np.unique(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))


@dataclass
class OrdinalModel:
    """``weights`` by place, ascending ``thresholds``; ``fitted`` is False if there was nothing to fit."""

    weights: np.ndarray
    thresholds: np.ndarray
    fitted: bool = True

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, one row per text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[f].sum(dtype=np.float64)) for f in features])


def telling_places(at: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, places: int) -> np.ndarray:
    """Places seen in MIN_ROWS texts or more whose share differs between a grade and the rest by TELLING standard errors."""
    seen = np.bincount(at, minlength=places)
    out = np.zeros(places, bool)
    for g in range(n_grades):
        n, rest = int((grades == g).sum()), int((grades != g).sum())
        if n and rest:
            own = np.bincount(at[grades[row] == g], minlength=places)
            p = seen / (n + rest)
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n + 1 / rest))
            out |= np.abs(own / n - (seen - own) / rest) >= TELLING * error
    return out & (seen >= min(MIN_ROWS, max(1, len(grades) // 10)))


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, places: int = PLACES, totals: np.ndarray | None = None) -> OrdinalModel:
    """Full-batch adaptive gradient descent on the cumulative-link likelihood; the same result for the same rows in the same order.

    ``totals``: rows per grade that the sample stands for (default: the sample's own)."""
    weights = np.zeros(places)
    present = np.unique(grades)
    if len(present) < 2:
        return OrdinalModel(weights, np.arange(n_grades - 1, dtype=float) - (n_grades - 2) / 2, fitted=False)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    at = np.concatenate(features) if len(features) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(features)), sizes)
    frequent = telling_places(at, row, grades, n_grades, places)
    use = frequent[at]
    at, row = at[use], row[use]
    # first threshold, and logs of the gaps: the thresholds stay ordered
    cut = np.concatenate([[-0.5], np.zeros(n_grades - 2)])
    # a grade weighs as much as all its labelled rows
    counts = np.bincount(grades, minlength=n_grades)
    totals = counts if totals is None else np.asarray(totals, float)
    share = (counts * totals.sum() / np.maximum(totals, 1))[grades]
    g_w, g_c = np.full(places, 1e-8), np.full(len(cut), 1e-8)
    for _ in range(ROUNDS):
        thresholds = np.concatenate([[cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))])
        eta = np.bincount(row, weights=weights[at], minlength=len(features))
        below = 1 / (1 + np.exp(np.clip(eta[:, None] - thresholds[None, :], -50, 50)))  # P(grade <= k)
        full = np.concatenate([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))], axis=1)
        slope = full * (1 - full)
        i = np.arange(len(eta))
        p = np.maximum(full[i, grades + 1] - full[i, grades], 1e-9)
        d_eta = (slope[i, grades + 1] - slope[i, grades]) / p / share  # gradient of -log p
        grad = np.bincount(at, weights=d_eta[row], minlength=places) + RIDGE * weights
        d_t = np.zeros(n_grades - 1)
        np.add.at(d_t, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -slope[i, grades + 1] / p / share, 0))
        np.add.at(d_t, np.maximum(grades - 1, 0), np.where(grades > 0, slope[i, grades] / p / share, 0))
        d_c = np.array([d_t.sum(), *(np.exp(cut[k]) * d_t[k:].sum() for k in range(1, len(cut)))])
        g_w += grad**2
        g_c += d_c**2
        weights = np.minimum(weights - STEP * grad / np.sqrt(g_w) * frequent, 0)
        cut -= STEP * d_c / np.sqrt(g_c)
    return OrdinalModel(weights.astype(np.float32), np.concatenate([[cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))]))


def graded_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from quality and toxic labels, one row per document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1), 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = Places()
    for batch in batches:
        found = [places.of(t.as_py() or "") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "grade", "places"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model of at most ``sample`` labelled rows per grade; only their feature lists come to the driver."""
    order = F.struct(F.xxhash64("doc_id"), "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    graded = graded_labels(labels)
    picked = graded.where("false")
    for g in range(GRADES):
        picked = picked.unionByName(graded.where(F.col("grade") == g).orderBy(order).limit(sample))
    # at most GRADES * sample ids and grades: a proven bound for the broadcast
    chosen = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")
    rows = chosen.mapInArrow(_features, "doc_id long, grade int, places array<int>").toPandas()
    rows["size"] = rows["places"].map(len)
    rows = rows.sort_values(["doc_id", "size"], kind="stable").drop_duplicates("doc_id")
    totals = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    return fit_ordinal([np.asarray(x, np.int64) for x in rows["places"]], rows["grade"].to_numpy(np.int64), totals=np.array([totals.get(g, 0) for g in range(GRADES)]))


def _score(model: OrdinalModel, keep_at: float, at: int, extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            n = batch.num_rows
            if model.fitted:
                tails = model.tails(model.score([places.of(t.as_py() or "") for t in batch.column(at)]))
                expected, top = pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])
                kept = pa.array(tails[:, -1] >= keep_at)
            else:
                expected = top = pa.nulls(n, pa.float64())
                kept = pa.array(np.ones(n, bool))
            if extra:
                yield pa.RecordBatch.from_arrays([batch.column(0), expected, top, kept], names=["doc_id", "expected_grade", "p_top", "kept"])
            else:
                yield batch.filter(kept)

    return run


def grade_documents(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, p_top, kept`` of every row."""
    model = fit(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model, keep_at, 1, True), "doc_id long, expected_grade double, p_top double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    return docs.mapInArrow(_score(fit(docs, labels), keep_at, docs.columns.index("text"), False), docs.schema)


def op8_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the whole ``documents`` table, from a fit on its ``labels``."""
    return grade_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
