"""Calibration, drift and the retrain decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import contracts as C
from tidemark.functions.ranking import exact_quantiles, global_row_number
from tidemark.session import checkpointed


def mature_window(
    scored: DataFrame, as_of: Column, *, date_col: str = "date_day", maturity_days: int = 14,
    window_days: int = 90,
) -> DataFrame:
    """Rows old enough for their label to be known, no older than the window."""
    day = F.col(date_col)
    return scored.filter(
        (day <= F.date_sub(as_of, maturity_days)) & (day > F.date_sub(as_of, window_days + maturity_days))
    )


def calibration_deciles(
    scored: DataFrame, *, pred: str = "churn_probability", label: str = "actual",
    tiebreak: str = "row_key", bins: int = 10,
) -> DataFrame:
    """Equal-count bins by predicted probability with predicted and actual rates.

    Bin edges fall as in a linear-interpolation quantile cut of ranks 1..N. The
    rank comes from bucket offsets, so no task sorts the whole table.
    """
    rows = checkpointed(scored.select(pred, label, tiebreak))
    ranked = global_row_number(rows, pred, tiebreak, out="__r")
    last = rows.agg(F.count(F.lit(1)) - 1).scalar()
    step = F.greatest(last, F.lit(1))
    # ceil((r - 1) * bins / (N - 1)) - 1, in whole numbers.
    decile = F.greatest(
        F.floor(((F.col("__r") - 1) * bins + step - 1) / step) - 1, F.lit(0)
    ).cast("int")
    out = ranked.groupBy(decile.alias("decile")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(pred).alias("__p"),
        F.avg(F.col(label).cast("double")).alias("__a"),
    )
    return out.select(
        "decile", "count",
        F.round("__p", 4).alias("avg_predicted"),
        F.round("__a", 4).alias("actual_rate"),
        F.round(F.abs(F.col("__p") - F.col("__a")), 4).alias("abs_deviation"),
    ).orderBy("decile")


def drift_flags(
    as_of: Column, *, train_start=None, train_end=None, recent_days: int = 30, fallback_months: int = 12,
) -> tuple[Column, Column]:
    """Whether a feature row is of the reference window (the training window, or the year before the recent days), and
    whether it is recent."""
    day = F.col("date_day")
    recent = day > F.date_sub(as_of, recent_days)
    if train_start is not None and train_end is not None:
        return day.between(F.lit(train_start).cast("date"), F.lit(train_end).cast("date")), recent
    start = F.add_months(as_of, -fallback_months)
    return (day >= start) & (day <= F.date_sub(as_of, recent_days)), recent


def drift_windows(features: DataFrame, as_of: Column, **window) -> tuple[DataFrame, DataFrame]:
    """The reference rows and the recent rows (``drift_flags``)."""
    reference, recent = drift_flags(as_of, **window)
    return features.filter(reference), features.filter(recent)


def _shifts(columns: list[str]) -> dict[str, Column]:
    """A what-if shift: fewer visits and logins, longer idle time, more failed payments."""
    shifts = {
        "sessions_attended_30d": F.col("sessions_attended_30d") * 0.3,
        "days_since_last_session": F.col("days_since_last_session") + 25,
        "app_logins_30d": F.col("app_logins_30d") * 0.4,
        "failed_payments_count_30d": F.col("failed_payments_count_30d") + 1,
    }
    return {k: v for k, v in shifts.items() if k in columns}


def perturb_window(current: DataFrame) -> DataFrame:
    """The rows after the what-if shift."""
    return current.withColumns(_shifts(current.columns))


def _value_counts(wide: DataFrame, features: list[str]) -> DataFrame:
    """Occurrences per feature and value on both sides, in one aggregation."""
    return (
        wide.unpivot(["in_ref", "in_cur"], features, "feature", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("feature", "value").agg(F.sum("in_ref").alias("nr"), F.sum("in_cur").alias("nc"))
    )


def _long_counts(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    def side(df: DataFrame, nr: int) -> DataFrame:
        return df.select(
            *[F.col(f).cast("double").alias(f) for f in features],
            F.lit(nr).alias("in_ref"), F.lit(1 - nr).alias("in_cur"),
        )

    return _value_counts(side(reference, 1).unionByName(side(current, 0)), features)


def _flagged_counts(
    df: DataFrame, reference: Column, current: Column, features: list[str], shifts: dict[str, Column],
) -> DataFrame:
    """The counts of rows that carry their windows as flags: one pass, a row of both windows counts on both sides."""
    def side(flag: Column, nr: int, changed: dict[str, Column]) -> Column:
        values = [changed.get(f, F.col(f)).cast("double").alias(f) for f in features]
        return F.when(flag, F.struct(F.lit(nr).alias("in_ref"), F.lit(1 - nr).alias("in_cur"), *values))

    sides = F.array_compact(F.array(side(reference, 1, {}), side(current, 0, shifts)))
    return _value_counts(df.filter(reference | current).select(F.inline(sides)), features)


def psi_table(
    reference: DataFrame, current: DataFrame, features: list[str], *, bins: int = 10,
    min_rows: int = 10, eps: float = 1e-6,
) -> DataFrame:
    """Population stability index per feature, all features in one job.

    Values are counted per feature first, so repeated values shuffle once.
    Fewer than ``min_rows`` values on a side, or fewer than three distinct
    edges, gives 0.
    """
    return _psi_of_counts(_long_counts(reference, current, features), bins, min_rows, eps)


def psi_of_windows(
    df: DataFrame, reference: Column, current: Column, features: list[str], *, shifts: dict[str, Column] | None = None,
    bins: int = 10, min_rows: int = 10, eps: float = 1e-6,
) -> DataFrame:
    """``psi_table`` of two windows of one table, given as flags of its rows; the table is read once.

    ``shifts`` changes the values of current rows.
    """
    return _psi_of_counts(_flagged_counts(df, reference, current, features, shifts or {}), bins, min_rows, eps)


def _psi_of_counts(counts: DataFrame, bins: int, min_rows: int, eps: float) -> DataFrame:
    both = checkpointed(counts)
    ref = both.filter(F.col("nr") > 0)
    probs = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(ref, ["feature"], "value", probs, weight="nr")
    # One fixed-length array per feature, kept because two joins read it.
    edges = checkpointed(q.groupBy("feature").agg(
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges")
    ))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    axis = edges.withColumn("inner", inner).drop("edges").withColumn("n_edges", F.size("inner") + 2)
    binned = (
        both.join(F.broadcast(axis), "feature")  # one row per feature
        .withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
        .groupBy("feature", "bin").agg(F.sum("nr").alias("nr"), F.sum("nc").alias("nc"))
    )
    totals = both.groupBy("feature").agg(F.sum("nr").alias("tr"), F.sum("nc").alias("tc"))
    full = axis.select(
        "feature", "n_edges", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin")
    )
    r = F.greatest(F.coalesce("nr", F.lit(0)) / F.col("tr"), F.lit(eps))
    c = F.greatest(F.coalesce("nc", F.lit(0)) / F.col("tc"), F.lit(eps))
    usable = (F.col("tr") >= min_rows) & (F.col("tc") >= min_rows) & (F.col("n_edges") >= 3)
    return (
        full.join(totals.filter((F.col("tr") > 0) & (F.col("tc") > 0)), "feature")
        .join(binned, ["feature", "bin"], "left")
        .groupBy("feature")
        .agg(F.sum(F.when(usable, (c - r) * F.ln(c / r)).otherwise(0.0)).alias("psi"))
    )


def feature_drift(
    reference: DataFrame, current: DataFrame, features: list[str] = C.DRIFT_FEATURES, *,
    significant: float = 0.20, moderate: float = 0.10, **options,
) -> DataFrame:
    """PSI per watched feature with its severity, worst first."""
    present = [f for f in features if f in reference.columns and f in current.columns]
    return _severity(psi_table(reference, current, present, **options), present, significant, moderate)


def window_drift(
    panel: DataFrame, reference: Column, current: Column, features: list[str] = C.DRIFT_FEATURES, *, perturb: bool = False,
    significant: float = 0.20, moderate: float = 0.10, **options,
) -> DataFrame:
    """``feature_drift`` of two windows of one panel (``drift_flags``), which is read once."""
    present = [f for f in features if f in panel.columns]
    table = psi_of_windows(panel, reference, current, present, shifts=_shifts(panel.columns) if perturb else None, **options)
    return _severity(table, present, significant, moderate)


def _severity(table: DataFrame, present: list[str], significant: float, moderate: float) -> DataFrame:
    names = table.sparkSession.createDataFrame([(f,) for f in present], "feature string")
    p = F.round(F.coalesce("psi", F.lit(0.0)), 4)
    return (
        names.join(table, "feature", "left")
        .withColumn("psi", p)
        .withColumn("severity", F.when(F.col("psi") >= significant, "Significant")
                    .when(F.col("psi") >= moderate, "Moderate").otherwise("Stable"))
        .orderBy(F.desc("psi"), "feature")
    )


def retrain_decision(
    calibration: DataFrame, drift: DataFrame, *, checked_at: Column, mode: str = "live",
    calibration_limit: float = 0.15, psi_limit: float = 0.25,
) -> DataFrame:
    """One log row: worst deviation, worst drift, and whether to retrain with the reasons."""
    dev = calibration.agg(F.coalesce(F.max("abs_deviation"), F.lit(0.0))).scalar()
    worst = drift.agg(
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
        F.max_by("feature", F.struct("psi", "feature")).alias("worst"),
    ).withColumn("calib_max_dev", dev)
    c = F.col
    bad_calibration = c("calib_max_dev") >= calibration_limit
    bad_drift = c("max_psi") >= psi_limit
    reasons = F.concat_ws(
        "; ",
        F.when(bad_calibration, F.concat(
            F.lit("calibration deviation "), F.format_string("%.1f", c("calib_max_dev") * 100),
            F.lit(f"% >= {calibration_limit:.0%}"))),
        F.when(bad_drift, F.concat(
            F.lit("feature drift PSI "), F.format_string("%.2f", c("max_psi")),
            F.lit(f" >= {psi_limit} ("), c("worst"), F.lit(")"))),
    )
    return worst.select(
        checked_at.alias("checked_at"),
        F.round("calib_max_dev", 4).alias("calib_max_dev"),
        F.round("max_psi", 4).alias("max_psi"),
        (bad_calibration | bad_drift).alias("needs_retrain"),
        F.when(reasons == "", "none").otherwise(reasons).alias("reasons"),
        F.lit(mode).alias("mode"),
    )
