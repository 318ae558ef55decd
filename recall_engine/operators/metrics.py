"""Model quality as tables. Scored rows have ``y_true``, ``y_pred`` (0/1) and ``y_proba``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.operators.global_order import dense_id, prefix_sums
from recall_engine.staging import stage

TINY = 1e-15  # fixed value: probabilities are clipped this far from 0 and 1 in the log loss

# Metric names in report order, and which direction is better.
OBJECTIVES = {
    "total_population": "neutral",
    "total_positive": "neutral",
    "total_negative": "neutral",
    "random_precision": "neutral",
    "true_positive": "maximum",
    "false_negative": "minimum",
    "false_positive": "minimum",
    "true_negative": "maximum",
    "recall": "maximum",
    "miss_rate": "minimum",
    "fall_out": "minimum",
    "specificity": "maximum",
    "precision": "maximum",
    "false_discovery_rate": "minimum",
    "false_omission_rate": "minimum",
    "negative_predictive_value": "maximum",
    "accuracy": "maximum",
    "prevalence": "neutral",
    "positive_likelihood_ratio": "maximum",
    "negative_likelihood_ratio": "minimum",
    "diagnostic_odds_ratio": "maximum",
    "f1_score": "maximum",
    "logit_roc_auc": "maximum",
    "explained_variance_score": "maximum",
    "max_error": "minimum",
    "mean_absolute_error": "minimum",
    "root_mean_squared_error": "minimum",
    "r2_score": "maximum",
    "normalised_log_loss": "minimum",
    "normalised_cross_entropy": "minimum",
    "brier_score": "minimum",
}


def _over(top: Column, bottom: Column) -> Column:
    """Ratio as a double, null where the denominator is 0 or unknown."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def _counts() -> list[Column]:
    """Aggregates of the confusion matrix."""
    true, pred = F.col("y_true"), F.col("y_pred")

    def cell(t: int, p: int) -> Column:
        return F.count_if((true == t) & (pred == p))

    return [
        F.count_if(true.isin(0, 1) & pred.isin(0, 1)).alias("total_population"),
        F.count_if(true == 1).alias("total_positive"),
        F.count_if(true == 0).alias("total_negative"),
        cell(1, 1).alias("true_positive"),
        cell(1, 0).alias("false_negative"),
        cell(0, 1).alias("false_positive"),
        cell(0, 0).alias("true_negative"),
    ]


def confusion_counts(scored: DataFrame, *groups: str) -> DataFrame:
    """Counts of the confusion matrix in one aggregation, and the precision of random guesses."""
    return _with_random_precision(scored.groupBy(*groups).agg(*_counts()))


def _with_random_precision(counts: DataFrame) -> DataFrame:
    return counts.withColumn("random_precision", _over(F.col("total_positive"), F.col("total_population")))


def binary_ratios(counts: DataFrame) -> DataFrame:
    """Ratios of the confusion matrix. Undefined ones are null.

    ``logit_roc_auc`` is the area for hard labels, (recall + specificity) / 2.
    """
    tp, fn, fp, tn = (
        F.col(c).cast("double") for c in ("true_positive", "false_negative", "false_positive", "true_negative")
    )
    n = F.col("total_population")
    recall, miss = _over(tp, tp + fn), _over(fn, tp + fn)
    fall_out, specificity = _over(fp, fp + tn), _over(tn, fp + tn)
    precision = _over(tp, tp + fp)
    positive, negative = _over(recall, fall_out), _over(miss, specificity)
    return counts.withColumns(
        {
            "recall": recall,
            "miss_rate": miss,
            "fall_out": fall_out,
            "specificity": specificity,
            "precision": precision,
            "false_discovery_rate": _over(fp, tp + fp),
            "false_omission_rate": _over(fn, fn + tn),
            "negative_predictive_value": _over(tn, fn + tn),
            "accuracy": _over(tp + tn, n),
            "prevalence": _over(tp + fn, n),
            "positive_likelihood_ratio": positive,
            "negative_likelihood_ratio": negative,
            "diagnostic_odds_ratio": _over(positive, negative),
            "f1_score": _over(2 * precision * recall, precision + recall),
            "logit_roc_auc": (recall + specificity) / 2,
        }
    )


def _moments() -> list[Column]:
    """Aggregates of the error of the probability."""
    y, p = F.col("y_true").cast("double"), F.col("y_proba").cast("double")
    error = y - p
    safe = F.greatest(F.least(p, F.lit(1 - TINY)), F.lit(TINY))
    return [
        F.var_pop(error).alias("_var_error"),
        F.var_pop(y).alias("_var_y"),
        F.max(F.abs(error)).alias("max_error"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.avg(error * error).alias("brier_score"),
        F.avg(-F.when(y == 1, F.log(safe)).otherwise(F.log(1 - safe))).alias("normalised_log_loss"),
        F.avg(y).alias("_share"),
    ]


def regression_metrics(scored: DataFrame, *groups: str) -> DataFrame:
    """Errors of the probability against the 0/1 truth, in one aggregation."""
    return scored.groupBy(*groups).agg(*_moments()).select(*groups, *_errors())


def _errors() -> list[Column]:
    share = F.col("_share")
    entropy = -(share * F.log(share) + (1 - share) * F.log(1 - share))

    def explained(unexplained: Column) -> Column:
        return F.when(F.col("_var_y") == 0, F.when(unexplained == 0, 1.0).otherwise(0.0)).otherwise(
            1 - _over(unexplained, F.col("_var_y"))
        )

    return [
        explained(F.col("_var_error")).alias("explained_variance_score"),
        F.col("max_error"),
        F.col("mean_absolute_error"),
        F.sqrt("brier_score").alias("root_mean_squared_error"),
        explained(F.col("brier_score")).alias("r2_score"),
        F.col("normalised_log_loss"),
        _over(F.col("normalised_log_loss"), entropy).alias("normalised_cross_entropy"),
        F.col("brier_score"),
    ]


def as_long(wide: DataFrame, *groups: str) -> DataFrame:
    """One row per metric: (metric, value)."""
    names = [c for c in wide.columns if c not in groups]
    doubles = wide.select(*groups, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(list(groups), names, "metric", "value")


def evaluate(scored: DataFrame, *groups: str) -> DataFrame:
    """All metrics of the scored rows in long form, from one pass over them."""
    both = scored.groupBy(*groups).agg(*_counts(), *_moments())
    wide = binary_ratios(_with_random_precision(both))
    errors = _errors()
    moments = ("_var_error", "_var_y", "_share", "max_error", "mean_absolute_error", "brier_score", "normalised_log_loss")
    kept = [c for c in wide.columns if c not in groups and c not in moments]
    return as_long(wide.select(*groups, *kept, *errors), *groups)


# --- comparing models -------------------------------------------------------------------------------


def side_by_side(long_metrics: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric, one column per model (a metric missing for a model is null)."""
    return long_metrics.groupBy("metric").pivot("model", models).agg(F.first("value"))


def with_objective(by_metric: DataFrame) -> DataFrame:
    """Add which direction of the metric is better, null for an unknown metric."""
    pairs = F.create_map(*[F.lit(x) for pair in OBJECTIVES.items() for x in pair])
    return by_metric.withColumn("objective", F.try_element_at(pairs, F.col("metric")))


def best_and_worst(by_metric: DataFrame, models: list[str]) -> DataFrame:
    """Per metric the best and the worst value; none when all models agree or the metric is neutral."""
    values = [F.col(m) for m in models]
    low, high = (F.least(*values), F.greatest(*values)) if len(values) > 1 else (values[0], values[0])
    goal = F.col("objective")
    decided = low != high
    return by_metric.withColumns(
        {
            "best": F.when(decided & (goal == "maximum"), high).when(decided & (goal == "minimum"), low),
            "worst": F.when(decided & (goal == "maximum"), low).when(decided & (goal == "minimum"), high),
        }
    )


# --- curves -----------------------------------------------------------------------------------------


def _cumulated(scored: DataFrame) -> DataFrame:
    """Per distinct probability, from high to low: positives and negatives there, so far, and in all."""
    counts = scored.groupBy("y_proba").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )
    return prefix_sums(
        counts.withColumn("one", F.lit(1)),
        [F.col("y_proba").desc()],
        {"tps": "pos", "fps": "neg", "rank": "one"},
        totals={"all_pos": "tps", "all_neg": "fps", "last": "rank"},
    )


def _points(rows: DataFrame, point: Column, extra: Column, keep: Column | None = None) -> DataFrame:
    """One point per row that is kept, and one extra point at the highest probability."""
    mine = point if keep is None else F.when(keep, point)
    both = F.when(F.col("rank") == 1, F.array(extra, mine)).otherwise(F.array(mine))
    return rows.select(F.explode(both).alias("_point")).filter(F.col("_point").isNotNull()).select("_point.*")


def roc_curve(scored: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """Points (fpr, tpr, threshold); the first is (0, 0) with the highest probability plus one.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    rows = _cumulated(scored)
    bends = None
    if drop_intermediate:
        # The curve bends at a point when the step after it differs from the step up to it.
        rows = stage(rows, "curve")
        after = rows.select(
            (F.col("rank") - 1).alias("rank"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
        )
        rows = rows.join(after, "rank", "left")
        bends = (
            (F.col("rank") == F.col("last")) | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        )
    point = F.struct(
        _over(F.col("fps"), F.col("all_neg")).alias("fpr"),
        _over(F.col("tps"), F.col("all_pos")).alias("tpr"),
        F.col("y_proba").alias("threshold"),
    )
    start = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), (F.col("y_proba") + 1).alias("threshold"))
    return _points(rows, point, start, bends)


def precision_recall_curve(scored: DataFrame) -> DataFrame:
    """Points (precision, recall, threshold, random_precision), down to the threshold of full recall.

    The closing point (1, 0) has no threshold.
    """
    share = _over(F.col("all_pos"), F.col("all_pos") + F.col("all_neg")).alias("random_precision")
    point = F.struct(
        _over(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        _over(F.col("tps"), F.col("all_pos")).alias("recall"),
        F.col("y_proba").alias("threshold"),
        share,
    )
    end = F.struct(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold"), share
    )
    return _points(_cumulated(scored), point, end, F.col("tps") - F.col("pos") < F.col("all_pos"))


def calibration_strip(scored: DataFrame, tie_break: str) -> DataFrame:
    """Rows in order of probability: position, right or wrong, and where the negatives would end."""
    placed = dense_id(scored, ["y_proba", tie_break], "position")
    negatives = scored.agg(F.count_if(F.col("y_true") == 0)).scalar()
    return placed.withColumns(
        {"correct": F.col("y_true") == F.col("y_pred"), "negatives": negatives}
    )


# --- distributions ----------------------------------------------------------------------------------


def histogram(scored: DataFrame, value: str, size: float) -> DataFrame:
    """Counts per bin ``[k * size, (k + 1) * size)``."""
    return _bins(scored, {"bin": value}, size)


def histogram_2d(scored: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return _bins(scored, {"x_bin": x, "y_bin": y}, size)


def _bins(scored: DataFrame, columns: dict[str, str], size: float) -> DataFrame:
    known = scored.dropna(subset=list(columns.values()))
    bins = [F.floor(F.col(c) / F.lit(float(size))).alias(n) for n, c in columns.items()]
    return known.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"))
