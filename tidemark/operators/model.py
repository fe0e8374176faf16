"""Churn model training, calibration, scoring and the registry, on Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import contracts as C
from tidemark.functions.expressions import count_when
from tidemark.functions.ranking import exact_quantiles, global_row_number
from tidemark.operators.scoring import with_risk_tier
from tidemark.session import checkpointed

MISSING = -1.0
# Decimals of raw probabilities in calibration, both when it is fitted and when it is applied.
DIGITS = 4
# Rows of a task while trees are fitted.
ROWS_PER_TASK = 500_000


def training_window(
    features: DataFrame, *, as_of: Column, months: int = 24, maturity_days: int = 14
) -> DataFrame:
    """Rows of the trailing months whose label is already known."""
    day = F.col("date_day")
    return features.filter(
        (day >= F.add_months(as_of, -months)) & (day <= F.date_sub(as_of, maturity_days))
    )


def training_window_meta(
    features: DataFrame, *, as_of: Column, months: int = 24, maturity_days: int = 14
) -> DataFrame:
    """Actual bounds and sizes of the window (one row)."""
    day = F.col("date_day")
    start = F.add_months(as_of, -months)
    inside = (day >= start) & (day <= F.date_sub(as_of, maturity_days))
    return features.agg(
        F.min(F.when(inside, day)).alias("window_start"),
        F.max(F.when(inside, day)).alias("window_end"),
        count_when(inside).alias("rows_in_window"),
        count_when(day < start).alias("rows_discarded_as_old"),
        F.min(day).alias("oldest_available"),
    )


def quantile_date(df: DataFrame, date_col: str = "date_day", q: float = 0.8) -> DataFrame:
    """Linear-interpolation quantile of a date, as seconds since the epoch (one row)."""
    seconds = df.select((F.unix_date(F.col(date_col)).cast("double") * 86400).alias("s"))
    return exact_quantiles(seconds.withColumn("g", F.lit(1)), ["g"], "s", [q]).select(
        F.col("quantile").alias("split_seconds")
    )


def chronological_split(
    df: DataFrame, *, date_col: str = "date_day", fraction: float = 0.8, split_date=None
) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the split date. The panel is never split at random.

    The split is the date quantile, or a fixed date. When one side of the
    quantile split is empty, as on a single-day window, rows are split by their
    order instead (``split_by_order``), ties by the hashed member.
    """
    if split_date is not None:
        before = F.col(date_col) < F.lit(split_date).cast("date")
    else:
        found = quantile_date(df, date_col, fraction).first()
        cut = F.lit(found[0] if found else None).cast("double")
        before = F.unix_date(F.col(date_col)).cast("double") * 86400 < cut
        if df.agg(F.count_distinct(before)).first()[0] == 1:
            key = F.sha2(F.concat("hashed_member_id", F.col(date_col).cast("string")), 256)
            parts = split_by_order(df.withColumn("__key", key), order=date_col, tiebreak="__key", fraction=fraction)
            return parts[0].drop("__key"), parts[1].drop("__key")
    return df.filter(before), df.filter(~before)


def split_by_order(df: DataFrame, *, order: str, tiebreak: str, fraction: float = 0.8):
    """First ``fraction`` of rows by time order, and the rest."""
    rows = checkpointed(df)
    cut = rows.agg(F.floor(F.count(F.lit(1)) * fraction)).scalar()
    ranked = global_row_number(rows, order, tiebreak, out="__r")
    first = F.col("__r") <= cut
    return ranked.filter(first).drop("__r"), ranked.filter(~first).drop("__r")


def class_weight(df: DataFrame, label: str = C.LABEL) -> DataFrame:
    """Negatives per positive, 1.0 without positives (one row)."""
    pos, neg = count_when(F.col(label)), count_when(~F.col(label))
    return df.agg(
        neg.alias("negatives"), pos.alias("positives"),
        F.when(pos > 0, neg / pos).otherwise(1.0).alias("scale_pos_weight"),
    )


def _prepared(df: DataFrame) -> DataFrame:
    """Missing numbers to the sentinel, flags to 0/1, the label as double."""
    fixes = {f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in C.NUMERIC_FEATURES}
    fixes |= {f: F.col(f).cast("double") for f in C.BOOLEAN_FEATURES}
    fixes |= {f: F.coalesce(F.col(f), F.lit("unknown")) for f in C.CATEGORICAL_FEATURES}
    if C.LABEL in df.columns:
        fixes["label"] = F.col(C.LABEL).cast("double")
    return df.withColumns(fixes)


def feature_stages(numbers: list[str] = C.NUMERIC_FEATURES) -> list:
    """Scale 21 numbers, one-hot 3 categories (unseen values ignored), pass 2 flags."""
    idx = [f"{f}_ix" for f in C.CATEGORICAL_FEATURES]
    hot = [f"{f}_oh" for f in C.CATEGORICAL_FEATURES]
    return [
        VectorAssembler(inputCols=numbers, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=C.CATEGORICAL_FEATURES, outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=["scaled", *hot, *C.BOOLEAN_FEATURES], outputCol="features"),
    ]


def feature_vectors(features: DataFrame) -> DataFrame:
    """Fit and apply the feature stages; adds ``features``."""
    data = _prepared(features)
    return Pipeline(stages=feature_stages()).fit(data).transform(data)


@dataclass
class ChurnModel:
    """A fitted classifier with optional isotonic calibration."""

    stages: PipelineModel
    calibrator: IsotonicRegressionModel | None = None

    def predict(self, features: DataFrame) -> DataFrame:
        """Input rows with ``churn_probability``."""
        raw = self.stages.transform(_prepared(features)).withColumn(
            "raw_probability", vector_to_array("probability")[1]
        )
        if self.calibrator is None:
            out = raw.withColumn("churn_probability", F.col("raw_probability"))
        else:
            out = self.calibrator.transform(raw.withColumn("raw_probability", F.round("raw_probability", DIGITS)))
        return out.select("hashed_member_id", "date_day", "churn_probability",
                          *[c for c in (C.LABEL,) if c in features.columns])

    @classmethod
    def load(cls, path: str) -> ChurnModel:
        """A model written by ``save``."""
        spark = SparkSession.getActiveSession()
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/calibrator")
        calibrated = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return cls(PipelineModel.load(f"{path}/stages"),
                   IsotonicRegressionModel.load(f"{path}/calibrator") if calibrated else None)

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")


def _fit(train: DataFrame, estimator) -> ChurnModel:
    """Fit all stages on rows materialised once: every stage and iteration reads them again."""
    cols = [*C.NUMERIC_FEATURES, *C.BOOLEAN_FEATURES, *C.CATEGORICAL_FEATURES, "label"]
    data = checkpointed(_prepared(train).select(*cols))
    weight = data.agg(
        F.coalesce(F.try_divide(F.sum(1 - F.col("label")), F.sum("label")), F.lit(1.0))
    ).first()[0]
    data = data.withColumn("weight", F.when(F.col("label") == 1.0, F.lit(weight)).otherwise(1.0))
    return ChurnModel(Pipeline(stages=[*feature_stages(), estimator]).fit(data))


def train_churn_lr(train: DataFrame, *, max_iter: int = 50) -> ChurnModel:
    """Class-balanced logistic regression."""
    return _fit(train, LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter))


# Bins of a number in the trees (Spark's own default), and the least number of parts the rows are drawn in.
BINS, LOTS = 32, 65_536


def number_bins(data: DataFrame, bins: int = BINS) -> Bucketizer:
    """Cuts each number into bins of about equal numbers of rows; a number with few values has a bin for each."""
    grid = [i / bins for i in range(1, bins)]
    few = data.agg(*[F.approx_count_distinct(f).alias(f) for f in C.NUMERIC_FEATURES]).first()
    found = data.agg(*[
        (F.array_sort(F.collect_set(f)) if few[f] <= bins else F.percentile_approx(f, grid, 100 * bins)).alias(f)
        for f in C.NUMERIC_FEATURES]).first()
    splits = []
    for f in C.NUMERIC_FEATURES:
        cuts = sorted({v for v in found[f] or [] if math.isfinite(v)})
        # A cut is the least value of its bin; of few values the least one is in the first bin, which has none.
        splits.append([-math.inf, *((cuts[1:] if few[f] <= bins else cuts) or [0.0]), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=C.NUMERIC_FEATURES,
                      outputCols=[f"{f}_bin" for f in C.NUMERIC_FEATURES], handleInvalid="keep")


def weighted_rows(binned: DataFrame, by: list[str], lots: int = LOTS) -> DataFrame:
    """Rows equal in ``by`` as one with their number in ``rows``.

    Trees are drawn a share of the rows each, so no row stands for more than one part in ``lots`` of all.
    """
    counted = checkpointed(binned.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("rows")))
    size = counted.agg(F.greatest(F.ceil(F.sum("rows") / lots), F.lit(1))).first()[0] or 1
    parts = F.ceil(F.col("rows") / size)
    return counted.withColumn("__parts", F.sequence(F.lit(1), parts)).withColumn(
        "rows", F.col("rows") / F.size("__parts")).withColumn("__part", F.explode("__parts")).drop("__parts", "__part")


def train_churn_gbt(
    train: DataFrame, *, trees: int = 150, depth: int = 5, rate: float = 0.08,
    subsample: float = 0.8, feature_share: str = "0.8", seed: int = 42,
) -> ChurnModel:
    """Boosted trees, class weighted.

    Trees see numbers by their bins only, so all rows are binned once, and those that no tree can tell apart are one
    row with their weight: the passes of the fit go over distinct rows.
    """
    data = _prepared(train)
    bins = number_bins(data)
    by = [*bins.getOutputCols(), *C.BOOLEAN_FEATURES, *C.CATEGORICAL_FEATURES, "label"]
    rows = weighted_rows(bins.transform(data), by)
    classes = rows.agg(
        F.coalesce(F.try_divide(F.sum((1 - F.col("label")) * F.col("rows")), F.sum(F.col("label") * F.col("rows"))), F.lit(1.0)),
        F.count(F.lit(1))).first()
    weight = F.col("rows") * F.when(F.col("label") == 1.0, F.lit(classes[0])).otherwise(1.0)
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-classes[1] // ROWS_PER_TASK))
    spread = checkpointed(rows.withColumn("weight", weight).repartition(tasks))
    fitted = Pipeline(stages=[*feature_stages(bins.getOutputCols()), GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees,
        maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
        featureSubsetStrategy=feature_share, seed=seed)]).fit(spread)
    return ChurnModel(PipelineModel([bins, *fitted.stages]))


def calibrate_isotonic(model: ChurnModel, held_out: DataFrame) -> ChurnModel:
    """Fit an isotonic map from raw probability to label on recent rows."""
    raw = model.stages.transform(_prepared(held_out)).select(
        vector_to_array("probability")[1].alias("raw_probability"), "label")
    return ChurnModel(model.stages, fit_isotonic(raw))


def fit_isotonic(rows: DataFrame, digits: int = DIGITS) -> IsotonicRegressionModel:
    """An isotonic map from (raw_probability, label) rows.

    The fit pools its points in the driver, so rows are first summed by rounded
    probability: with four digits it gets 10,001 weighted points at most.
    """
    points = checkpointed(rows.groupBy(F.round("raw_probability", digits).alias("raw_probability")).agg(
        F.avg(F.col("label").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")))
    return IsotonicRegression(
        featuresCol="raw_probability", labelCol="label", weightCol="weight", predictionCol="churn_probability").fit(points)


def score_members(model: ChurnModel, snapshot: DataFrame) -> DataFrame:
    """De-identified scores with tiers for one day's members."""
    p = model.predict(snapshot).select(
        "hashed_member_id", F.col("date_day").alias("score_date"), "churn_probability"
    )
    return with_risk_tier(p)


def feature_importance(model: ChurnModel, sample: DataFrame, top: int = 15) -> DataFrame:
    """Largest importances (trees) or absolute coefficients (linear) with attribute names."""
    spark = sample.sparkSession
    fitted = model.stages.stages[-1]
    values = getattr(fitted, "featureImportances", None)
    values = fitted.coefficients if values is None else values
    meta = model.stages.transform(_prepared(sample).limit(0)).schema["features"].metadata
    attrs = [a for kind in meta["ml_attr"]["attrs"].values() for a in kind]
    names = dict(enumerate(C.NUMERIC_FEATURES))  # the scaled vector comes first, unnamed
    rows = [(names.get(a["idx"], a["name"]), float(abs(values[a["idx"]]))) for a in attrs]
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature").limit(top)
    )


def registry_record(
    meta: DataFrame, metrics: DataFrame, *, version_id: str, trained_at: Column, trigger: str,
    window_months: int, model_path: str,
) -> DataFrame:
    """One registry row from one-row frames of window bounds and validation metrics."""
    m = metrics.agg(F.struct(*[F.first(c).alias(c) for c in metrics.columns])).scalar()
    return meta.withColumn("__m", m).select(
        F.lit(version_id).alias("version_id"), trained_at.alias("trained_at"),
        F.lit(trigger).alias("trigger"), F.col("window_start").alias("train_window_start"),
        F.col("window_end").alias("train_window_end"), F.lit(window_months).alias("window_months"),
        F.col("__m.train_rows"), F.col("__m.val_rows"), "rows_discarded_as_old",
        F.round("__m.scale_pos_weight", 1).alias("scale_pos_weight"),
        F.round("__m.val_auc", 4).alias("val_auc"), F.round("__m.val_pr_auc", 4).alias("val_pr_auc"),
        F.lit(model_path).alias("model_path"),
    )


def registry_latest(registry: DataFrame) -> DataFrame:
    """The newest training record."""
    return registry.orderBy(F.desc("trained_at"), F.desc("version_id")).limit(1)
