"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share the mix by weight; a target stops at ``max_repeat`` times its source's words and the excess goes to the others by
weight. A document's expected copies are its source's target over its source's words (times its own weight over the mean, where
documents have weights). Whole copies are certain. For the fraction p that is left, documents are ranked by random odds
over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the target's words are reached: a
sample of fixed size in words with unequal probabilities. u comes from a digest of doc_id, so reruns agree.

A source is never one task: ranks are mapped to (0, 1) and cut into 4096 and again 4096 buckets; words per bucket are summed
with partial aggregation, running sums find the bucket in which the target is met, and only its rows are put in order.

Defined results: null text has size 0 and takes no words; a source without words has target 0 and takes none; a null source is a source of its own, last; a null doc_id has the draw of
an empty id; rows that repeat a doc_id share its draw and are taken next to each other; no rows, no result; columns beside
``doc_id, text, source`` are carried by :func:`mixed_documents` and ignored by :func:`mix_sources`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votepanel.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS, SEED = 4096, 20240501


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: shares by weight, capped, excess reshared until none is above its cap."""
    ranked = sizes.withColumn("_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    fill = Window.orderBy("_full", "_no")
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # filled in order of the level at which a source is full; the level is final at the first source that is not full there
    levels = (
        ranked.withColumn("_w", w)
        .withColumn("_cap", cap)
        .withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everything).cast("double") - F.col("_before")) / F.col("_rest"))
        .withColumn("_final", F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "_no", "_level"))).over(everything)["_level"])
    )
    return levels.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_w") * F.col("_final")), F.col("_cap")).alias("target"))


def _meets(sums: DataFrame, keys: list[str], bucket: str, start: Column) -> DataFrame:
    """The bucket of each group in which the running sum (from ``start``) goes past the goal, and the sum before it."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_sum", start + F.coalesce(F.sum("words").over(w), F.lit(0))).where((F.col("_sum") <= F.col("goal")) & (F.col("goal") < F.col("_sum") + F.col("words")))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3, seed: int = SEED, doc_weight: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row (and the columns ``keep``).

    ``doc_weight``: column of positive numbers that scales a document's expected copies within its source (null counts 1)."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.coalesce(F.col(doc_weight).cast("double"), F.lit(1.0)) if doc_weight else F.lit(1.0)
    rows = cut_lineage(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), own.alias("_own"), draw(F.col("doc_id"), seed).alias("_u"), *[F.col(c).alias(f"_keep_{c}") for c in keep]), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_own") * F.col("size")).alias("_own_size"))
    targets = source_targets(sizes, weights, max_repeat).withColumnRenamed("source", "_s").join(sizes.select(F.col("source").alias("_t"), "_own_size"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    targets = cut_lineage(targets, "targets")
    expected = F.coalesce(F.least(F.lit(float(max_repeat)), F.try_divide(F.col("target"), F.col("_own_size")) * F.col("_own")), F.lit(0.0))
    p = F.col("_e") - F.col("_whole")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    place = F.when(p > 0, odds / (1 + odds))
    ranked = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_e", expected)
        .withColumn("_whole", F.floor("_e"))
        .withColumn("_q", F.when(p > 0, odds))
        .withColumn("_place", place)
        .withColumn("_b1", F.when(F.col("_place").isNotNull(), F.least(F.floor(F.col("_place") * BUCKETS), F.lit(BUCKETS - 1))))
        .withColumn("_b2", F.floor(F.col("_place") * (BUCKETS * BUCKETS)))
        .drop("_s")
    )
    certain = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("size"))).alias("goal")).withColumnRenamed("source", "_c")
    same = F.col("source").eqNullSafe(F.col("_c"))
    open_rows = ranked.where("_b1 is not null")
    first = _meets(open_rows.groupBy("source", "_b1").agg(F.sum("size").alias("words")).join(certain, same).drop("_c"), ["source"], "_b1", F.lit(0))
    first = cut_lineage(first.select(F.col("source").alias("_c"), F.col("_b1").alias("_m1"), F.col("_sum").alias("_sum1"), "goal"), "first_bucket")
    inner = open_rows.join(first, same & (F.col("_b1") == F.col("_m1")))
    second = _meets(inner.groupBy("source", "_b2").agg(F.sum("size").alias("words"), F.first("goal").alias("goal"), F.first("_sum1").alias("_sum1")), ["source"], "_b2", F.col("_sum1"))
    second = second.select(F.col("source").alias("_d"), F.col("_b2").alias("_m2"), F.col("_sum").alias("_sum2"))
    edges = cut_lineage(certain.join(first.drop("goal").withColumnRenamed("_c", "_f"), F.col("_c").eqNullSafe(F.col("_f")), "left").drop("_f").join(second, F.col("_c").eqNullSafe(F.col("_d")), "left").drop("_d"), "edges_of_sources")
    met = ranked.join(edges, same, "left").drop("_c")
    # a goal no bucket goes past takes every open row (goal reached) or none (negative by rounding)
    before = F.when(F.col("_m1").isNull(), F.col("goal") >= 0).when(F.col("_b1") != F.col("_m1"), F.col("_b1") < F.col("_m1")).when(F.col("_m2").isNull(), F.lit(True)).otherwise(F.col("_b2") < F.col("_m2"))
    on_edge = (F.col("_b1") == F.col("_m1")) & (F.col("_b2") == F.col("_m2"))
    met = met.withColumn("_edge", F.coalesce(on_edge, F.lit(False))).withColumn("_in", F.coalesce(F.col("_b1").isNotNull() & before, F.lit(False)))
    cols = [F.col("doc_id"), "size", "source_size", "target", "_whole", *[F.col(f"_keep_{c}").alias(c) for c in keep]]
    run = Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = met.where("_edge").withColumn("_before", F.col("_sum2") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    edge = edge.select(*cols, (F.col("_before") + F.col("size") / 2.0 <= F.col("goal")).alias("_in"))
    out = met.where("not _edge").select(*cols, "_in").unionByName(edge)
    copies = F.col("_whole") + F.col("_in").cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), *keep)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken; rows without words are left out."""
    own = {c: f"_col{i}" for i, c in enumerate(docs.columns)}
    if options.get("doc_weight"):
        options["doc_weight"] = own[options["doc_weight"]]
    plan = mix_sources(docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(name) for c, name in own.items()]), keep=list(own.values()), **options)
    taken = plan.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col(name).alias(c) for c, name in own.items()])


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1, repeating; targets stop at three times a source's words."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS no FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(no - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS full_at, coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(source_size) OVER ())::DOUBLE AS total FROM w),
l AS (SELECT *, (total - before) / rest AS level FROM f),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM l WHERE full_at >= level ORDER BY full_at, no LIMIT 1)), cap) AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target, coalesce(least(3.0::DOUBLE, target / source_size::DOUBLE), 0) AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(e) AS whole, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM e),
c AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS goal,
        coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN q IS NOT NULL AND before + size / 2.0 <= goal THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  (whole + CASE WHEN q IS NOT NULL AND before + size / 2.0 <= goal THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""
