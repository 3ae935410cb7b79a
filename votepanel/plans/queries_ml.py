"""Registered model queries (Spark ML). Metric / prediction tables have no SQL oracle (iterative fits):
the driver records rows-only checks; tests bound them against the naive last-value predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from votepanel.operators import folds as FO
from votepanel.operators import metrics as ME
from votepanel.operators import ml as ML
from votepanel.plans import oracle as O
from votepanel.plans.catalog import register
from votepanel.plans.panel import build_panel
from votepanel.plans.queries_core import long_table, mapping_table
from votepanel.session import cut_lineage, round_doubles

RIDGE = {"alpha": 1.0}
GBT = {"max_iter": 20, "max_depth": 3, "learning_rate": 0.1, "min_samples_leaf": 30}


def panel_frame(spark, sf):
    """The panel written once to the shared checkpoint folder: every fit reads it, none recomputes the
    vote-table joins."""
    return cut_lineage(build_panel(long_table(spark, sf), mapping_table(spark, sf)), "panel")


def _folds(panel, k=3):
    return FO.event_folds(FO.event_table(panel), k)


@register("boosted_trees")
def q_boosted_trees(spark, sf):
    p = panel_frame(spark, sf)
    train, test = p.where(F.col("election_year") <= 1999), p.where(F.col("election_year") >= 2000)
    model = ML.fit_multi_output(train, ML.default_features(), "gbt", GBT)
    return round_doubles(ME.regression_metrics(ML.predictions_long(model.transform(test))))


#: Rounds of the trees in the registered query.
HURDLE = {"max_iter": 5, "max_depth": 3, "learning_rate": 0.3, "min_samples_leaf": 30}


@register("two_stage")
def q_two_stage(spark, sf):
    """Seven targets of the years from 2000: probability, value and their product, normalised per station-election."""
    p = panel_frame(spark, sf)
    out = ML.two_stage(p.where(F.col("election_year") < 2000), p.where(F.col("election_year") >= 2000), ML.default_features(), params=HURDLE)
    return round_doubles(ME.normalise_predictions(out.withColumn("y_pred", F.col("prediction"))))


_SW_SQL = O.with_ctes(*O.model_table_sql_ctes(1995)) + """, c as (select bloc, count(*) as n from mt_final group by bloc),
 m as (select bloc, (max(n) over ()) / n as inv from c)
 select f.code_bv, f.bloc, f.date_scrutin, f.type_scrutin, f.tour, """ + O.r6("coalesce(m.inv, 1.0) * (1 + 2.0 * greatest(f.part_bloc, 0.0))") + """ as sample_weight
 from mt_final f left join m on f.bloc = m.bloc"""


@register("sample_weights", _SW_SQL)
def q_sample_weights(spark, sf):
    from votepanel.plans.queries_more import model_frame

    w = ML.sample_weights(model_frame(spark, sf))
    return round_doubles(w.select("code_bv", "bloc", "date_scrutin", "type_scrutin", "tour", "sample_weight"))


def _numeric_sql() -> str:
    names = [*ML.default_features(with_turnout_of_target=True), "target_sum_before_renorm", "target_sum_after_renorm"]
    return f"with p as ({O.panel_sql()}) select * from (" + " union all ".join(f"select '{c}' as feature, count({c}) as n from p" for c in names) + ") where n > 0"


@register("select_numeric_features", _numeric_sql)
def q_select_numeric_features(spark, sf):
    """Numeric columns of the panel that a model may use, with their filled rows."""
    return ML.numeric_features(panel_frame(spark, sf))
