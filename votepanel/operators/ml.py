"""Share models on Spark ML: preprocessing, per-category regressors, folds, calibration.

The panel is assembled once per fit (one cached feature frame shared by the 7 category models); fits
are distributed by Spark ML; the fold and grid loops only drive a handful of fits from the driver.
Training data is bounded by stations x elections, far smaller than the raw vote tables.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votepanel.constants import CATEGORIES, PANEL_FEATURES, TARGET_COLS
from votepanel.session import cut_lineage

META_COLS = ("commune_code", "code_bv", "election_type", "election_year", "round", "date_scrutin")


def default_features(*, with_turnout_of_target: bool = False) -> list[str]:
    """Lag features of the panel plus previous turnouts (Q21: the target election's own turnout is a
    leak and is left out unless ``with_turnout_of_target``)."""
    feats = [f"{p}{c}" for p, _ in PANEL_FEATURES[1:] for c in CATEGORIES] + ["prev_turnout_any_lag1", "prev_turnout_same_type_lag1"]
    return feats + (["turnout_pct"] if with_turnout_of_target else [])


def numeric_candidates(df: DataFrame, exclude: tuple[str, ...] = (*META_COLS, *TARGET_COLS)) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in exclude and f.dataType.typeName() in ("double", "float", "integer", "long")]


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = (*META_COLS, *TARGET_COLS)) -> DataFrame:
    """``feature, n``: numeric non-key, non-target columns with their filled rows, those without any left out (one aggregation pass)."""
    names = numeric_candidates(df, exclude)
    counts = df.agg(*[F.count(c).alias(c) for c in names]) if names else df.sparkSession.createDataFrame([], "feature string, n long")
    return counts.unpivot([], names, "feature", "n").where("n > 0") if names else counts


def select_numeric_features(df: DataFrame, exclude: tuple[str, ...] = (*META_COLS, *TARGET_COLS)) -> list[str]:
    """Their names, in the order of the columns."""
    kept = {r.feature for r in numeric_features(df, exclude).collect()}
    return [c for c in numeric_candidates(df, exclude) if c in kept]


def preprocessor(features: list[str], *, prefix: str = "") -> list:
    """Median impute -> assemble -> drop near-constant features -> standardise (mean and scale)."""
    imputed = [f"{prefix}imp_{c}" for c in features]
    return [
        Imputer(strategy="median", relativeError=0.001, inputCols=features, outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol=f"{prefix}raw", handleInvalid="keep"),
        VarianceThresholdSelector(varianceThreshold=1e-6, featuresCol=f"{prefix}raw", outputCol=f"{prefix}sel"),
        StandardScaler(withMean=True, withStd=True, inputCol=f"{prefix}sel", outputCol=f"{prefix}features"),
    ]


def make_regressor(kind: str, params: dict, *, features_col: str, label_col: str, prediction_col: str, weight_col: str | None = None):
    if kind == "ridge":
        est = LinearRegression(regParam=float(params.get("alpha", 1.0)), elasticNetParam=0.0, standardization=False,
                               featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col)
    elif kind == "gbt":
        # Spark's trees have a smallest leaf and subsampling, but no penalty on leaf values
        est = GBTRegressor(maxIter=int(params.get("max_iter", 20)), maxDepth=int(params.get("max_depth", 3)), stepSize=float(params.get("learning_rate", 0.1)),
                           minInstancesPerNode=int(params.get("min_samples_leaf", 1)), subsamplingRate=float(params.get("subsample", 1.0)), featureSubsetStrategy=str(params.get("features_per_split", "all")),
                           lossType=str(params.get("loss", "squared")), seed=42, featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col)
    else:
        raise ValueError(kind)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


#: Rows of the fits that run at the same time, each of which keeps its own copy: small fits leave most cores idle, large ones go one by one.
ROWS_AT_ONCE = 2_000_000


def prepare(train: DataFrame, features: list[str], targets: tuple[str, ...] = TARGET_COLS, *, weight_col: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """The fitted preprocessing, and the prepared training rows, written once for the fits of all targets and settings."""
    known = train.where(F.col(targets[0]).isNotNull())
    base = Pipeline(stages=preprocessor(features)).fit(known)
    return base, cut_lineage(base.transform(known).select("features", *targets, *([weight_col] if weight_col else [])), "fit_rows")


def fit_targets(data: DataFrame, kind: str, params: dict, targets: tuple[str, ...] = TARGET_COLS, *, weight_col: str | None = None) -> list:
    """A model of every target on prepared rows."""

    def fit(t: str):
        return make_regressor(kind, params, features_col="features", label_col=t, prediction_col=f"pred_{t.replace('target_share_', '')}", weight_col=weight_col).fit(data)

    at_once = max(1, min(len(targets), data.sparkSession.sparkContext.defaultParallelism, ROWS_AT_ONCE // max(1, data.count())))
    with ThreadPool(at_once) as pool:
        return pool.map(inheritable_thread_target(data.sparkSession)(fit), targets)


def fit_multi_output(train: DataFrame, features: list[str], kind: str = "ridge", params: dict | None = None, *,
                     targets: tuple[str, ...] = TARGET_COLS, weight_col: str | None = None) -> PipelineModel:
    """One regressor per category on one shared preprocessing; predictions in ``pred_{category}``."""
    base, data = prepare(train, features, targets, weight_col=weight_col)
    return PipelineModel(stages=[*base.stages, *fit_targets(data, kind, params or {}, targets, weight_col=weight_col)])


def predictions_long(scored: DataFrame, *, targets: tuple[str, ...] = TARGET_COLS, keys: tuple[str, ...] = ("code_bv", "election_type", "election_year", "round"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide predictions -> long diag rows (y_true / y_pred per category), predictions clipped and
    normalised per row (sum 0 -> 1). ``keep``: more columns of the rows."""
    keys = (*keep, *keys)
    cats = [t.replace("target_share_", "") for t in targets]
    clipped = [F.least(F.greatest(F.col(f"pred_{c}"), F.lit(0.0)), F.lit(1.0)) for c in cats]
    total = None
    for e in clipped:
        total = e if total is None else total + e
    d = scored.select(*keys, *[F.col(t) for t in targets], *[e.alias(f"_p_{c}") for e, c in zip(clipped, cats)], total.alias("_s"))
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.col(t).alias("y_true"), (F.col(f"_p_{c}") / F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))).alias("y_pred")) for c, t in zip(cats, targets)])
    return d.select(*keys, F.explode(arr).alias("x")).select(*keys, "x.*")


def select_best(cv_summary: DataFrame, bias_threshold: float = 0.02) -> DataFrame:
    """Keep |bias| <= threshold when any does, then sort by mean MAE, worst category MAE, |bias|, RMSE,
    SMAPE (each to 9 decimals, so that rounding noise decides nothing), then setting, and take the first row."""
    cat_cols = [c for c in cv_summary.columns if c.startswith("mae_") and c != "mae_mean"]
    d = cv_summary.withColumn("worst_block_mae", F.greatest(*[F.col(c) for c in cat_cols])).withColumn("bias_abs", F.abs("bias"))
    small = F.col("bias_abs") <= bias_threshold
    d = d.withColumn("_ok", small | ~F.coalesce(F.bool_or(small).over(Window.partitionBy()), F.lit(False))).where("_ok").drop("_ok")  # a row a setting
    order = [F.floor(F.col(c) * 1e9).asc_nulls_last() for c in ("mae_mean", "worst_block_mae", "bias_abs", "rmse", "smape")]
    return d.orderBy(*order, *[F.col(c) for c in ("model", "setting") if c in d.columns]).limit(1)


def sample_weights(df: DataFrame, *, bloc_col: str = "bloc", y_col: str = "part_bloc", alpha: float = 2.0) -> DataFrame:
    """Inverse bloc frequency (max count / count) x (1 + alpha x y clipped at 0)."""
    counts = df.groupBy(bloc_col).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(bloc_col, (F.max("_n").over(Window.partitionBy()) / F.col("_n")).alias("_inv"))
    d = df.join(F.broadcast(counts), on=bloc_col, how="left")
    w = F.coalesce(F.col("_inv"), F.lit(1.0)) * (1 + F.lit(alpha) * F.greatest(F.col(y_col), F.lit(0.0)))
    return d.withColumn("sample_weight", w).drop("_inv")


def two_stage(train: DataFrame, test: DataFrame, features: list[str], targets: tuple[str, ...] = TARGET_COLS, *, epsilon: float = 1e-4, threshold: float = 0.5, use_proba: bool = True, use_logit: bool = True,
              logit_eps: float = 1e-6, classifier: str = "gbt", kind: str = "gbt", params: dict | None = None, keys: tuple[str, ...] = ("code_bv", "election_type", "election_year", "round")) -> DataFrame:
    """Hurdle model of every target: P(y > epsilon) by a classifier (``gbt`` trees or ``logistic``), and a regressor of the rows above it.

    ``use_logit``: the regressor learns the logit of y. ``use_proba``: the prediction is probability times value; otherwise the value
    where the probability reaches ``threshold`` and 0 elsewhere. A target with one class only has its share of positive rows as
    probability (1 or 0) and, without positive rows, value 0. Returns ``keys, category, y_true, proba, value, prediction`` (raw)."""
    params = params or {"max_iter": 20, "max_depth": 3}
    base = Pipeline(stages=preprocessor(features)).fit(train)
    # prepared once for the fits of all targets
    tr = cut_lineage(base.transform(train).select("features", *targets), "two_stage_train")
    te = base.transform(test)
    rates = tr.agg(*[F.avg((F.col(t) > epsilon).cast("double")).alias(t) for t in targets]).first()
    for t in targets:
        known = tr.where(F.col(t).isNotNull()).withColumn("_pos", (F.col(t) > epsilon).cast("double"))
        proba, value, raw = f"_proba_{t}", f"_value_{t}", f"_raw_{t}"
        if rates[t] in (0.0, 1.0, None):
            te = te.withColumn(proba, F.lit(rates[t]).cast("double"))
        else:
            columns = dict(featuresCol="features", labelCol="_pos", predictionCol=f"_class_{t}")
            if classifier == "gbt":
                est = GBTClassifier(maxIter=int(params.get("max_iter", 20)), maxDepth=int(params.get("max_depth", 3)), stepSize=float(params.get("learning_rate", 0.1)), minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=42, **columns)
            else:
                est = LogisticRegression(**columns)
            est.setProbabilityCol(f"_prob_{t}").setRawPredictionCol(f"_rawclass_{t}")
            te = est.fit(known).transform(te).withColumn(proba, F.element_at(vector_to_array(F.col(f"_prob_{t}")), 2)).drop(f"_class_{t}", f"_prob_{t}", f"_rawclass_{t}")
        if not rates[t]:
            te = te.withColumn(value, F.lit(0.0))
            continue
        y = F.least(F.greatest(F.col(t), F.lit(logit_eps)), F.lit(1 - logit_eps))
        positive = known.where("_pos = 1").withColumn("_y", F.log(y / (1 - y)) if use_logit else F.col(t))
        te = make_regressor(kind, params, features_col="features", label_col="_y", prediction_col=raw).fit(positive).transform(te)
        back = 1 / (1 + F.exp(-F.col(raw))) if use_logit else F.col(raw)
        te = te.withColumn(value, F.least(F.greatest(back, F.lit(0.0)), F.lit(1.0))).drop(raw)

    def row(t: str):
        p, v = F.col(f"_proba_{t}"), F.col(f"_value_{t}")
        return F.struct(F.lit(t.replace("target_share_", "")).alias("category"), F.col(t).alias("y_true"), p.alias("proba"), v.alias("value"), (p * v if use_proba else F.when(p >= threshold, v).otherwise(0.0)).alias("prediction"))

    return te.select(*keys, F.explode(F.array(*[row(t) for t in targets])).alias("x")).select(*keys, "x.*")


def log_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(f"log_{target}", F.log1p(F.col(target)))
