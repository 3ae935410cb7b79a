"""Panel plans: long table -> station x election panel (flagship) and its building blocks.

Physical shape of ``build_panel`` (see ``.explain``): scan/joins of the long table (dealt by ``code_bv``
at the end) -> broadcast join with the checked mapping -> explode -> aggregate per station-event-category in the same tasks ->
broadcast join with the tiny reference table -> ONE hash exchange on ``code_bv`` -> all lag windows,
the single pivot aggregate and the turnout windows run inside that partitioning (no further shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES, EVENT_COLS, INDEX_COLS, PANEL_FEATURES, TARGET_COLS
from votepanel.operators.aggregate import aggregate_event, national_reference
from votepanel.operators.mapping import expand_by_category
from votepanel.operators.reshape import pivot_category
from votepanel.operators.windows import panel_lags, turnout_lags
from votepanel.session import cut_lineage, task_number

#: Rows of the event-category table a task of the station windows holds.
ROWS_A_TASK = 200_000


def event_category_table(long_df: DataFrame, mapping: DataFrame, *, reference_df: DataFrame | None = None, broadcast: bool | None = None) -> DataFrame:
    """``local`` table: station x election x category with share, rates and the reference share.

    ``reference_df``: rows the reference is computed on (defaults to the same rows, Q17).
    """
    # The mapping (a row a party code) and the reference (elections x categories) are broadcast whatever their tables' sizes: a shuffle join
    # with them would deal the large side by a few hot keys and drop its partitioning by station.
    small = broadcast is not False
    local = aggregate_event(expand_by_category(long_df, mapping, broadcast=small))
    # The compact event-category table feeds two consumers (reference aggregate and the station
    # windows). Writing it once to the shared checkpoint folder avoids recomputing the long-table joins
    # for each consumer and cuts the lineage (survives executor loss); one hash exchange on the station
    # key then serves every window and the pivot downstream.
    local = cut_lineage(local, "event_category")
    ref_local = local if reference_df is None else aggregate_event(expand_by_category(reference_df, mapping, broadcast=small))
    nat = national_reference(ref_local)
    out = local.join(F.broadcast(nat) if small else nat, on=[*EVENT_COLS, "category"], how="left")
    # A row needs about 1.5 KB of a task's memory in those windows: the number of partitions follows the rows (read from the files'
    # footers), as adaptive coalescing goes by compressed bytes. After the join, which may deal the rows otherwise.
    return out.repartition(task_number(local.sparkSession, local.count(), ROWS_A_TASK), "code_bv")


def renormalise_targets(panel: DataFrame, targets: tuple[str, ...] = TARGET_COLS) -> DataFrame:
    """Null -> 0, clip to [0, 1], divide by the row sum when positive; keep sums before/after."""
    clipped = [F.least(F.greatest(F.coalesce(F.col(t), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for t in targets]
    panel = panel.select(*[c for c in panel.columns if c not in targets], *[e.alias(t) for e, t in zip(clipped, targets)])
    total = None
    for t in targets:
        total = F.col(t) if total is None else total + F.col(t)
    panel = panel.withColumn("target_sum_before_renorm", total)
    has_mass = F.col("target_sum_before_renorm") > 0
    panel = panel.select(
        *[c for c in panel.columns if c not in targets],
        *[F.when(has_mass, F.col(t) / F.col("target_sum_before_renorm")).otherwise(F.col(t)).alias(t) for t in targets],
    )
    after = None
    for t in targets:
        after = F.col(t) if after is None else after + F.col(t)
    return panel.withColumn("target_sum_after_renorm", after)


PANEL_COLUMNS = (
    *INDEX_COLS,
    *[f"{p}{c}" for p, _ in PANEL_FEATURES for c in CATEGORIES],
    "turnout_pct",
    "prev_turnout_any_lag1",
    "prev_turnout_same_type_lag1",
    "target_sum_before_renorm",
    "target_sum_after_renorm",
)


def build_panel(long_df: DataFrame, mapping: DataFrame, *, strict_before: bool = False, broadcast: bool | None = None) -> DataFrame:
    """Flagship: prepared long table + normalised mapping -> panel (7 targets, 35 lag features, turnout).

    Semantics kept from the original: a station-event without any valid share is not a panel row
    (Q19); feature columns always exist (Q20); lag order is date, type, round (Q14).
    """
    # event_category_table is hash-partitioned on code_bv: every later window / aggregate is keyed by
    # code_bv + more columns, so no further exchange is planned.
    local = event_category_table(long_df, mapping, broadcast=broadcast)
    lagged = panel_lags(local, strict_before=strict_before)
    wide = pivot_category(
        lagged,
        INDEX_COLS,
        PANEL_FEATURES,
        extra=[F.max("turnout_pct").alias("turnout_pct"), F.count("share").alias("_n_share")],
    )
    wide = turnout_lags(wide).where(F.col("_n_share") > 0).drop("_n_share")
    return renormalise_targets(wide).select(*PANEL_COLUMNS)
