"""Star schema on Parquet tables: dimensions, facts, key lookups and upserts.

The original loads a relational database row by row. Here every table is a DataFrame written as
Parquet under a warehouse folder; uniqueness constraints become anti-joins (insert-if-absent) or
replace-by-key unions (insert-or-update). Surrogate ids are dense ranks over the natural key, new keys
of an upsert continue after the largest existing id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES, INDEX_COLS, TARGET_COLS
from votepanel.operators.reshape import melt
from votepanel.session import cut_lineage


def melt_panel(panel: DataFrame) -> DataFrame:
    """Targets wide -> long (category without its prefix), keeping ids and turnout."""
    return melt(panel, [*INDEX_COLS, "turnout_pct"], list(TARGET_COLS), "category", "share", strip_prefix="target_share_")


def dense_ids(keys: DataFrame, key_cols: list[str], *, id_col: str = "id", start_after: int = 0) -> DataFrame:
    """Surrogate ids 1..n (after ``start_after``) of the distinct keys, ordered by the natural key.

    The keys are written in ranges. A range numbers its own keys, after the sizes of the ranges before it; only these
    sizes, one row a range, meet in one task."""
    ranges = keys.select(*key_cols).distinct().repartitionByRange(*key_cols).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges, "key_ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*key_cols))
    ids = ranges.withColumn("_place", place).join(starts, "_range")
    return ids.select(*key_cols, (F.col("_before") + F.col("_place") + F.lit(start_after)).cast("int").alias(id_col))


def station_part(code_bv) -> F.Column:
    """Station code without its town prefix (text after the first ``-``)."""
    return F.regexp_replace(code_bv, r"^[^-]*-", "")


def star_dimensions(long_panel: DataFrame) -> dict[str, DataFrame]:
    cats = long_panel.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(CATEGORIES)], "id int, name string")
    towns = dense_ids(long_panel.select(F.col("commune_code").alias("insee_code")).where(F.col("insee_code").isNotNull()).distinct(), ["insee_code"])
    towns = towns.select("id", F.col("insee_code").alias("name_normalized"), "insee_code")
    st = long_panel.select("commune_code", station_part(F.col("code_bv")).alias("bureau_code")).distinct()
    st = st.join((towns.select(F.col("insee_code").alias("commune_code"), F.col("id").alias("commune_id"))), on="commune_code")
    bureaux = dense_ids(st.select("commune_id", "bureau_code"), ["commune_id", "bureau_code"]).select(
        "id", "commune_id", "bureau_code", F.lit(None).cast("string").alias("bureau_label")
    )
    ev = long_panel.groupBy("election_type", "election_year", F.coalesce("round", F.lit(1)).alias("round")).agg(F.min("date_scrutin").alias("date"))
    elections = dense_ids(ev.select("election_type", "election_year", "round"), ["election_type", "election_year", "round"]).join(
        ev, on=["election_type", "election_year", "round"]
    )
    return {"categories": cats, "communes": towns, "bureaux": bureaux, "elections": elections.select("id", "election_type", "election_year", "round", "date")}


def key_lookup(long_panel: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Natural keys -> surrogate ids by inner joins with the (checked, broadcast) dimensions; rows whose
    keys are unknown are dropped."""
    towns = dims["communes"].select(F.col("insee_code").alias("commune_code"), F.col("id").alias("commune_id"))
    b = dims["bureaux"].select(F.col("id").alias("bureau_id"), "commune_id", "bureau_code")
    e = dims["elections"].select(F.col("id").alias("election_id"), "election_type", "election_year", "round")
    c = dims["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    d = long_panel.withColumn("bureau_code", station_part(F.col("code_bv"))).withColumn("round", F.coalesce("round", F.lit(1)))
    d = d.join((towns), on="commune_code").join((b), on=["commune_id", "bureau_code"])
    d = d.join((e), on=["election_type", "election_year", "round"]).join(F.broadcast(c), on="category")
    return d


def star_facts(long_panel: DataFrame, dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """results_local (share and turnout in percent) and results_national (unweighted means)."""
    lk = key_lookup(long_panel.where(F.col("category").isin(*CATEGORIES)), dims)
    local = lk.select(
        "bureau_id", "election_id", "category_id",
        F.bround(F.col("share") * 100, 6).alias("share_pct"),
        F.lit(None).cast("double").alias("votes"), F.lit(None).cast("double").alias("expressed"),
        (F.col("turnout_pct") * 100).alias("turnout_pct"),
    )
    # percentages have 6 decimals: averaged as integer micro-units, so the mean is exact and does not
    # depend on summation order (partitioning)
    micro = F.round(F.bround(F.col("share") * 100, 6) * 1_000_000).cast("long")
    nat_share = lk.groupBy("election_id", "category_id").agg((F.sum(micro) / F.count(micro) / F.lit(1_000_000.0)).alias("share_pct"))
    # turnout of an election: mean over its station rows (one per station, not per category)
    turn = lk.where(F.col("category") == CATEGORIES[0]).groupBy("election_id").agg((F.avg("turnout_pct") * 100).alias("turnout_pct"))
    nat = nat_share.join(turn, on="election_id", how="left").select(
        "election_id", "category_id", "share_pct", F.lit(None).cast("double").alias("votes"), F.lit(None).cast("double").alias("expressed"), "turnout_pct"
    )
    return {"results_local": local, "results_national": nat}


def upsert_ignore(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Insert rows whose key is absent; existing rows are kept unchanged."""
    return old.unionByName(new.join(old.select(*keys), on=keys, how="left_anti"))


def upsert_update(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: a new row overwrites every measure of the old one (nulls included)."""
    return old.join(new.select(*keys), on=keys, how="left_anti").unionByName(new)


def key_range(col: str, width: int):
    """Partition number of an integer key: rows of ``width`` neighbouring keys are together."""
    return F.floor(F.col(col) / width).cast("long")


def create_merge_table(df: DataFrame, path: str, part) -> None:
    """A Parquet table in partitions ``part`` (a column expression over its keys) that :func:`merge_table` can change in place."""
    df.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(path)


def merge_table(spark, path: str, new: DataFrame, keys: list[str], part, *, update: bool = True) -> DataFrame:
    """Insert rows of ``new`` and, with ``update``, replace rows of the same key; the changed table.

    Only partitions that hold a changed key are read, merged and rewritten; files of all others stay as they are. The merged rows are
    written to a folder of their own first, so that a job that is lost half-way has changed nothing; then the touched
    partitions are overwritten. Several new rows of one key: the largest row stays. Rows without a key are not taken."""
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    changed = cut_lineage(new.where(named).withColumn("part", part).groupBy("part", *keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("_row")).select("part", *keys, "_row.*"), "merge_new")
    old = spark.read.schema(changed.schema).parquet(path)
    same = ["part", *keys]

    def in_parts_of(df: DataFrame) -> DataFrame:
        # numbers of partitions, at most as many as the table has and gets: the scan lists these folders only
        return old.where(F.col("part").isin([r.part for r in df.select("part").distinct().collect()]))

    if not update:  # rows that are there already change nothing
        changed = cut_lineage(changed.join(in_parts_of(changed).select(*same), same, "left_anti"), "merge_new")
    kept = in_parts_of(changed).join(changed.select(*same), same, "left_anti")
    merged = cut_lineage(kept.select(*changed.columns).unionByName(changed), "merged")
    if not merged.isEmpty():
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return spark.read.schema(changed.schema).parquet(path).drop("part")


def write_star(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    out = {}
    for name, df in tables.items():
        p = f"{path}/{name}"
        df.write.mode(mode).parquet(p)
        out[name] = p
    return out


def history_star_join(spark, paths: dict[str, str], commune_code: str | None = None) -> DataFrame:
    """Station history back from the star: facts x 4 dimensions, left join of the national fact."""
    rl = spark.read.parquet(paths["results_local"])
    b = spark.read.parquet(paths["bureaux"]).select(F.col("id").alias("bureau_id"), "commune_id", "bureau_code", "bureau_label")
    cm = spark.read.parquet(paths["communes"]).select(F.col("id").alias("commune_id"), F.col("insee_code").alias("commune_code"))
    e = spark.read.parquet(paths["elections"]).select(F.col("id").alias("election_id"), "election_type", "election_year", "round", F.col("date").alias("date_scrutin"))
    c = spark.read.parquet(paths["categories"]).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    rn = spark.read.parquet(paths["results_national"]).select("election_id", "category_id", F.col("share_pct").alias("share_nat_pct"))
    if commune_code is not None:
        cm = cm.where(F.col("commune_code") == commune_code)
    j = rl.join((b), "bureau_id").join((cm), "commune_id").join((e), "election_id").join(F.broadcast(c), "category_id")
    j = j.join(rn, on=["election_id", "category_id"], how="left")
    return j.select(
        "commune_code",
        F.concat(F.col("commune_code"), F.lit("-"), F.lpad("bureau_code", 4, "0")).alias("code_bv"),
        "election_type", "election_year", F.coalesce("round", F.lit(1)).alias("round"), "date_scrutin", "category",
        (F.col("share_pct") / 100).alias("share"), (F.col("share_nat_pct") / 100).alias("share_nat"), (F.col("turnout_pct") / 100).alias("turnout_pct"),
    )


def load_flat_table(df: DataFrame, path: str) -> DataFrame:
    """Replace-load of a processed table (Parquet); the loaded table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
