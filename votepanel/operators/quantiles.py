"""Exact quantiles without sending a whole group to one task.

The values of all groups are written once and put into ranges of (group, value) of about RANGE_ROWS rows each, so a large group is many ranges
and small groups share one; a value with very many rows is more than one range too. Ties of a range are counted together. Counts
per group and range give, by a running sum, the range that holds each wanted rank; only the values of those ranges are put in
order. The order statistics are exact wherever the ranges are cut, and are interpolated linearly (same definition as ``percentile`` /
``quantile_cont``). Null group keys are groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votepanel.session import cut_lineage

#: Rows a range holds, about: their number grows with the data, their size does not.
RANGE_ROWS = 200_000
#: Parts that the rows of one value may be cut into.
TIE_PARTS = 1024


def exact_quantiles(df: DataFrame, value: Column | str, qs: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per group (``keys``) with one column per name in ``qs``; null where a group has no value. No rows, no result."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    # Nothing is dealt by the session's partitions: their number need not follow the rows, which the ranges do.
    rows = cut_lineage(df.select(*keys, key.alias("_g"), x.alias("_x")), "quantiles")
    groups = rows.groupBy("_g").agg(F.count("_x").alias("_all"), *[F.first(k).alias(k) for k in keys])
    values = rows.where("_x is not null").select("_g", "_x", (F.monotonically_increasing_id() % TIE_PARTS).alias("_tie"))
    dealt = values.repartitionByRange(rows.count() // RANGE_ROWS + 1, "_g", "_x", "_tie")  # ties of a part are summed in the same tasks
    counted = dealt.groupBy("_g", "_x", "_tie").agg(F.count(F.lit(1)).alias("_n"))
    placed = cut_lineage(counted.select("_g", "_x", "_n", F.spark_partition_id().alias("_b")), "quantile_ranges")
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("_g", "_b").agg(F.sum("_n").alias("_bn")).withColumn("_from", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    # both neighbours of every wanted position
    places = [(name, end, fn(F.lit(float(q)) * (F.col("_all") - 1)).cast("long")) for name, q in qs.items() for end, fn in (("lo", F.floor), ("hi", F.ceil))]
    wanted = groups.where("_all > 0").select("_g", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("end"), k.alias("k")) for n, e, k in places])).alias("w")).select("_g", "w.*")
    # Written, so that their size is known: a few ranks are broadcast to the ranges, which stay where they are.
    hits = cut_lineage(wanted.join(buckets, "_g").where((F.col("_from") <= F.col("k")) & (F.col("k") < F.col("_from") + F.col("_bn"))), "quantile_hits")
    inner = Window.partitionBy("_g", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(hits.select("_g", "_b", "_from").distinct(), ["_g", "_b"]).withColumn("_start", F.col("_from") + F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    found = near.drop("_from").join(hits.select("_g", "_b", "name", "end", "k"), ["_g", "_b"]).where((F.col("_start") <= F.col("k")) & (F.col("k") < F.col("_start") + F.col("_n")))
    picked = found.groupBy("_g").agg(*[F.max(F.when((F.col("name") == n) & (F.col("end") == e), F.col("_x"))).alias(f"_{e}_{n}") for n, e, _ in places])
    out = groups.join(picked, "_g", "left")

    def between(name: str, q: float) -> Column:
        pos = F.lit(float(q)) * (F.col("_all") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(name)

    return out.select(*keys, *[between(n, q) for n, q in qs.items()])
