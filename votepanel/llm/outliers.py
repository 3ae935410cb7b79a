"""Quality rules: text statistics, base rules, and robust multivariate outliers per language and source.

The statistics of a text are turned into five numbers: log words, log mean word length, log symbols per hundred words, share of repeated
lines, share of repeated words. Per group (language and source; sources with under MIN_GROUP rows are pooled in their language; a pool under
MIN_GROUP is judged by the estimate of its whole language, large sources included, and a language under it by that of all rows) the
minimum covariance determinant is estimated over the rows that pass the base rules: from a start, concentration steps
repeatedly take the three quarters of the rows with the smallest Mahalanobis distances and recompute mean and covariance. Two
starts run side by side (coordinate medians and deviations; classical moments), and the smaller determinant wins. Rows
beyond CUTOFF squared distance, a chi-square tail of 1e-6 at five degrees of freedom, are rejected.

Distribution. Numbers are fixed-point integers, so sums of moments are exact and do not depend on the order of rows. The rank of
a distance comes from a histogram over a fine logarithmic grid (the whole grid cell at the rank is taken). So a step is two
aggregations with map-side partials; only one row per group is solved in numpy. Rows meet the parameters of their group by joins on the
group and a salt, so that a group's rows spread over SALTS tasks whatever share of all rows it holds.

Defined results: null text has no words and fails the base rules; null language or source is the empty name; every
row that passes the base rules has a distance; a covariance is never under FLOOR per number, so constant numbers are no
singularity; repeated rows count each; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votepanel.llm.hashing import WordIds, gram_hashes
from votepanel.session import cut_lineage

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
P, UNIT, MIN_GROUP, STEPS, SHARE, SALTS = 5, 1024, 50, 5, 0.75, 32
#: Smallest standard deviation of each number; covariance of the inner 3/4 to that of all rows (normal, five numbers); chi-square tail.
FLOOR, CONSISTENCY, CUTOFF = (0.30, 0.08, 0.35, 0.08, 0.08), 1.41, 37.3
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def text_stats(text: str, ids: WordIds) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    words = text.encode().split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    grams = gram_hashes(ids.of(words), 5)
    if len(grams) > 1:
        _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
        change = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(count[back] > 1)
        change[at] += 1
        change[at + 5] -= 1
        repeated = int((np.cumsum(change)[:n] > 0).sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    for batch in batches:
        rows = [text_stats(t.as_py() or "", ids) for t in batch.column(3)]
        cols = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(_STATS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["doc_id", "lang", "source", *_STATS])


def _numbers() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    logs = [F.log1p(F.col("n_words")), F.log1p(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / n), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(logs)]


def solve(n: int, sums: list[int], products: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and log determinant from exact integer moments (in units of 1 / UNIT)."""
    mean = np.array([s / n for s in sums])
    cov = np.empty((P, P))
    for (i, j), q in zip(_PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = (q * n - sums[i] * sums[j]) / (n * n)
    cov = cov * CONSISTENCY / UNIT**2 + np.diag(np.square(FLOOR))
    return mean / UNIT, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for row in batch.to_pylist():
            mean, inverse, det = solve(row["n"], [row[f"s{i}"] for i in range(P)], [int(row[f"q{i}{j}"]) for i, j in _PAIRS])
            out[0].append(mean.tolist())
            out[1].append([inverse[i, j] for i, j in _PAIRS])
            out[2].append(det)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.list_(pa.float64())), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.float64())], names=["g", "start", "mean", "inverse", "det"])


def _fit(chosen: DataFrame) -> DataFrame:
    """Parameters per group and start from the chosen rows."""
    moments = chosen.groupBy("g", "start").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")).alias(f"q{i}{j}") for i, j in _PAIRS]
    )
    return moments.mapInArrow(_solve, "g string, start int, mean array<double>, inverse array<double>, det double")


def _distance() -> Column:
    d = [F.col(f"x{i}") / float(UNIT) - F.col("mean")[i] for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + F.col("inverse")[k] * d[i] * d[j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _spread(df: DataFrame) -> DataFrame:
    """One row a group -> one for each salt of its rows."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _nearest(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The SHARE of each group's rows with the smallest distances, up to a grid cell of 1/64 in log2."""
    far = rows.join(_spread(params), ["g", "start", "salt"]).withColumn("cell", F.floor(64 * F.log2(1 + _distance())))
    cells = far.groupBy("g", "start", "cell").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("g", "start")
    cells = cells.withColumn("upto", F.sum("n").over(every.orderBy("cell"))).withColumn("all", F.sum("n").over(every))
    limit = cells.where(F.col("upto") >= SHARE * F.col("all")).groupBy("g", "start").agg(F.min("cell").alias("last"))
    return far.drop("mean", "inverse", "det").join(_spread(limit), ["g", "start", "salt"]).where("cell <= last").select("g", "start", *[f"x{i}" for i in range(P)])


def _median_start(rows: DataFrame) -> DataFrame:
    """Coordinate medians and absolute deviations as a diagonal start; from counts per distinct value."""

    def median(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("g", "i")
        counts = df.groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
        return counts.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "i").agg(F.min("v").alias(name))

    long = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("i", "v"))
    centre = median(long, "m")
    spread = median(long.join(centre, ["g", "i"]).select("g", "i", F.abs(F.col("v") - F.col("m")).alias("v")), "s")
    both = centre.join(spread, ["g", "i"]).groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for c in "ms" for i in range(P)])
    var = [F.pow(1.4826 * F.col(f"s{i}") / UNIT, F.lit(2)) + FLOOR[i] ** 2 for i in range(P)]
    inverse = [1 / var[i] if i == j else F.lit(0.0) for i, j in _PAIRS]
    return both.select("g", F.lit(0).alias("start"), F.array(*[F.col(f"m{i}") / float(UNIT) for i in range(P)]).alias("mean"), F.array(*inverse).alias("inverse"), F.lit(0.0).alias("det"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, squared ``distance`` (null where the base rules fail) and ``kept`` of every row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _STATS)
    stats = text.mapInArrow(_stats, schema).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")  # copies spread too
    stats = cut_lineage(stats.select("*", salt, *_numbers()), "stats")
    named = F.to_json(F.array("lang", "source"))
    pooled, whole, every = F.to_json(F.array("lang")), F.to_json(F.array("lang", F.lit(""), F.lit(""))), F.lit("[]")
    sound = stats.where("not base_failed")
    counts = cut_lineage(sound.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "counts")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)).alias("pool"))
    tiny = langs.agg(F.coalesce(F.min("all") < MIN_GROUP, F.lit(False)).alias("tiny"))
    own = F.when(F.col("n") >= MIN_GROUP, named).when(F.col("pool") >= MIN_GROUP, pooled).when(F.col("all") >= MIN_GROUP, whole).otherwise(every)
    # the wider estimates are made only where a pool or a language needs them
    wide = [F.when((F.col("pool") > 0) & (F.col("pool") < MIN_GROUP) & (F.col("all") >= MIN_GROUP), whole), F.when(F.col("tiny"), every)]
    groups = counts.join(langs, "lang").crossJoin(tiny).select("lang", "source", own.alias("g"), F.array_compact(F.array_distinct(F.array(own, *wide))).alias("member"))
    groups = cut_lineage(groups, "groups")
    rows = sound.join(_spread(groups), ["lang", "source", "salt"]).select(F.explode("member").alias("g"), "salt", *[f"x{i}" for i in range(P)])
    rows = cut_lineage(rows, "numbers")
    start = _median_start(rows).unionByName(_fit(rows.withColumn("start", F.lit(1))))
    params = cut_lineage(start, "mcd_start")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(2):
        params = cut_lineage(_fit(_nearest(both, params)), "mcd")
    best = params.groupBy("g").agg(F.min(F.struct("det", "start"))["start"].alias("start"))
    params = params.join(best, ["g", "start"])
    for _ in range(STEPS - 2):
        params = cut_lineage(_fit(_nearest(rows.join(_spread(params.select("g", "start")), ["g", "salt"]), params)), "mcd")
    scored = stats.join(_spread(groups.drop("member")), ["lang", "source", "salt"], "left").join(_spread(params.drop("start", "det")), ["g", "salt"], "left").withColumn("distance", F.when(~F.col("base_failed") & F.col("mean").isNotNull(), _distance()))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"), "distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over the whole ``documents`` table."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
