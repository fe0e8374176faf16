"""Classification metrics over a scored frame (prediction, 0/1 label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import count_when, ratio
from tidemark.functions.ranking import global_row_number, in_ranges, running_totals
from tidemark.session import checkpointed

PRED, LABEL = "churn_probability", "actual"


def _by_score(scored: DataFrame, pred: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before any ordering."""
    y = F.col(label).cast("int")
    return scored.groupBy(F.col(pred).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )


def auc_roc(scored: DataFrame, *, pred: str = PRED, label: str = LABEL) -> DataFrame:
    """Area under the ROC curve by the tie-aware rank sum."""
    t = running_totals(_by_score(scored, pred, label), "score", ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return t.agg(
        F.round(ratio(wins, F.sum("pos") * F.sum("neg")), 6).alias("auc_roc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )


def average_precision(scored: DataFrame, *, pred: str = PRED, label: str = LABEL) -> DataFrame:
    """Sum of recall steps times precision at each distinct score, highest first."""
    t = running_totals(_by_score(scored, pred, label), "score", ["pos", "neg"], descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return t.agg(
        F.round(ratio(F.sum(F.col("pos") * precision), F.sum("pos")), 6).alias("average_precision")
    )


def roc_curve(scored: DataFrame, *, pred: str = PRED, label: str = LABEL) -> DataFrame:
    """One point per distinct score: rates when predicting positive at or above it."""
    by_score = checkpointed(_by_score(scored, pred, label))
    totals = by_score.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    t = running_totals(by_score, "score", ["pos", "neg"], descending=True).withColumn("__t", totals)
    return t.select(
        F.col("score").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("__t.n")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("__t.p")).alias("tpr"),
    )


def confusion_at(
    scored: DataFrame, threshold: float = 0.35, *, pred: str = PRED, label: str = LABEL
) -> DataFrame:
    return scored.groupBy(
        F.col(label).cast("int").alias("actual"),
        (F.col(pred) >= threshold).cast("int").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(
    scored: DataFrame, threshold: float = 0.35, *, pred: str = PRED, label: str = LABEL
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    y, p = F.col(label).cast("int"), (F.col(pred) >= threshold).cast("int")
    cells = scored.agg(
        count_when((y == 1) & (p == 1)).alias("tp"), count_when((y == 0) & (p == 1)).alias("fp"),
        count_when((y == 1) & (p == 0)).alias("fn"), count_when((y == 0) & (p == 0)).alias("tn"),
    )

    def safe(num: Column, den: Column) -> Column:
        return F.coalesce(ratio(num, den), F.lit(0.0))

    c = F.col
    total = c("tp") + c("fp") + c("fn") + c("tn")

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        prec, rec = safe(hit, hit + wrong), safe(hit, hit + missed)
        f1 = safe(2 * hit, 2 * hit + wrong + missed)
        return F.struct(
            F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
            f1.alias("f1"), (hit + missed).alias("support"),
        )

    lines = F.array(line("0", c("tn"), c("fn"), c("fp")), line("1", c("tp"), c("fp"), c("fn")))
    accuracy = F.round(safe(c("tp") + c("tn"), total), 6).alias("accuracy")
    return cells.select(F.explode(lines).alias("l"), accuracy).select(
        "l.class", F.round("l.precision", 6).alias("precision"), F.round("l.recall", 6).alias("recall"),
        F.round("l.f1", 6).alias("f1"), "l.support", "accuracy",
    )


def precision_at_top_k(
    scored: DataFrame, k: float = 0.10, *, pred: str = PRED, label: str = LABEL,
    tiebreak: str = "row_key",
) -> DataFrame:
    """Mean label over the top floor(n * k) scores.

    Scores are cut into ranges; ranges above the cut count whole, unsorted, and only the range the cut falls in
    is ranked.
    """
    rows = in_ranges(scored.select(pred, label, tiebreak), pred, out="__range")
    # One row per range.
    sizes = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, above, cut = int(sum(sizes.values()) * k), 0, None
    for number in sorted(sizes, reverse=True):
        if above + sizes[number] > wanted:
            cut = number
            break
        above += sizes[number]
    top = rows if cut is None else rows.filter(F.col("__range") > cut)
    if cut is not None and above < wanted:
        part = rows.filter(F.col("__range") == cut)
        ranked = global_row_number(part, pred, tiebreak, descending=True, out="__r").filter(F.col("__r") <= wanted - above)
        top = top.unionByName(ranked.drop("__r"))
    return top.agg(
        F.count(F.lit(1)).alias("top_rows"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("precision_at_k"),
    )


def calibration_curve_uniform(
    scored: DataFrame, bins: int = 10, *, pred: str = PRED, label: str = LABEL
) -> DataFrame:
    """Mean prediction and positive share in equal-width bins (low, high]; empty bins are absent."""
    b = F.greatest(F.ceil(F.col(pred) * bins), F.lit(1))
    return scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(pred), 6).alias("prob_pred"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("prob_true"),
    )


def fairness_slices(
    scored: DataFrame, slices: tuple[str, ...] = ("gender", "home_studio_id"),
    threshold: float = 0.35, *, pred: str = PRED, label: str = LABEL,
) -> DataFrame:
    """Observed and predicted rates per value of each slice column, in one pass."""
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for s in slices:
        here = F.grouping(s) == 0
        name = F.when(here, s).otherwise(name)
        value = F.when(here, F.col(s)).otherwise(value)
    flagged = (F.col(pred) >= threshold).cast("double")
    return (
        scored.groupingSets([[F.col(s)] for s in slices], *slices)
        .agg(
            name.alias("slice"), value.alias("value"),
            F.count(F.lit(1)).alias("records"),
            F.round(F.avg(F.col(label).cast("double")), 6).alias("observed_churn_rate"),
            F.round(F.avg(pred), 6).alias("avg_predicted_prob"),
            F.round(F.avg(flagged), 6).alias("predicted_churn_rate"),
        )
        .drop(*slices)
    )
