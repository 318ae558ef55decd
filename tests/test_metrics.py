"""Metrics at their edges, and curves on a hand-made example."""

import math

import pytest
from pyspark.sql import functions as F

from recall_engine.operators import metrics, reports

SCHEMA = "y_true DOUBLE, y_pred DOUBLE, y_proba DOUBLE"


def ratios(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return metrics.binary_ratios(metrics.confusion_counts(df)).first().asDict()


def test_no_false_positive_leaves_likelihood_undefined(spark):
    got = ratios(spark, [(1.0, 1.0, 0.9), (0.0, 0.0, 0.1), (1.0, 0.0, 0.4)])
    assert got["fall_out"] == 0 and got["positive_likelihood_ratio"] is None
    assert got["diagnostic_odds_ratio"] is None and got["negative_likelihood_ratio"] == 0.5
    assert got["logit_roc_auc"] == (got["recall"] + got["specificity"]) / 2 == 0.75


def test_no_predicted_positive(spark):
    got = ratios(spark, [(1.0, 0.0, 0.1), (0.0, 0.0, 0.2)])
    assert got["precision"] is None and got["f1_score"] is None and got["recall"] == 0.0
    assert got["accuracy"] == 0.5 and got["random_precision"] == 0.5


def test_metrics_are_the_31_of_the_catalogue(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.9), (0.0, 1.0, 0.6)], SCHEMA)
    got = metrics.evaluate(df)
    assert {r.metric for r in got.collect()} == set(metrics.OBJECTIVES) and len(metrics.OBJECTIVES) == 31


def test_regression_metrics(spark):
    y, p = [1.0, 0.0, 1.0], [0.8, 0.3, 1.0]
    got = metrics.regression_metrics(spark.createDataFrame([(a, 0.0, b) for a, b in zip(y, p)], SCHEMA)).first()
    errors = [a - b for a, b in zip(y, p)]
    mse = sum(e * e for e in errors) / 3
    loss = -(math.log(0.8) + math.log(0.7) + math.log(1 - 1e-15)) / 3
    share = 2 / 3
    assert got.brier_score == pytest.approx(mse) and got.root_mean_squared_error == pytest.approx(math.sqrt(mse))
    assert got.r2_score == pytest.approx(1 - mse / (share * (1 - share)))
    assert got.normalised_log_loss == pytest.approx(loss)
    entropy = -(share * math.log(share) + (1 - share) * math.log(1 - share))
    assert got.normalised_cross_entropy == pytest.approx(loss / entropy)
    assert got.max_error == pytest.approx(0.3)


def test_curves(spark):
    rows = [(0.0, 0.0, 0.1), (0.0, 0.0, 0.4), (1.0, 0.0, 0.35), (1.0, 0.0, 0.8)]
    df = spark.createDataFrame(rows, SCHEMA)
    roc = sorted((r.fpr, r.tpr, r.threshold) for r in metrics.roc_curve(df).collect())
    assert roc == [(0.0, 0.0, 1.8), (0.0, 0.5, 0.8), (0.5, 0.5, 0.4), (0.5, 1.0, 0.35), (1.0, 1.0, 0.1)]
    curve = sorted((r.recall, r.precision) for r in metrics.precision_recall_curve(df).collect())
    assert curve == [(0.0, 1.0), (0.5, 0.5), (0.5, 1.0), (1.0, pytest.approx(2 / 3))]


def test_equal_probabilities_make_one_point(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (0.0, 1.0, 0.5)], SCHEMA)
    assert sorted((r.fpr, r.tpr) for r in metrics.roc_curve(df).collect()) == [(0.0, 0.0), (1.0, 1.0)]


def test_best_and_worst(spark):
    df = spark.createDataFrame([("recall", 0.5, 0.7), ("max_error", 0.5, 0.7), ("accuracy", 0.5, 0.5), ("prevalence", 0.1, 0.2)], "metric STRING, a DOUBLE, b DOUBLE")
    done = metrics.best_and_worst(metrics.with_objective(df), ["a", "b"])
    got = {r.metric: (r.best, r.worst) for r in done.collect()}
    assert got == {"recall": (0.7, 0.5), "max_error": (0.5, 0.7), "accuracy": (None, None), "prevalence": (None, None)}


def test_trial_log_formats(spark):
    line = "Finished trial#3 resulted in value: 12.5 with parameters: {'learning_rate': 0.1, 'max_depth': 7, 'reg_lambda': 1e-05}."
    log = spark.createDataFrame([(line,)], "value STRING")
    row = reports.trial_score(reports.trial_parameters(log, ["learning_rate", "max_depth", "reg_lambda"])).first()
    assert (row.learning_rate, row.max_depth, row.reg_lambda, row.MAE) == (0.1, 7, 1e-05, 12.5)


def test_best_trial_prefers_the_earliest(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.0), (4, None)], "n INT, s DOUBLE")
    assert reports.best_trial(df, "s", "n").first().n == 2
    assert reports.best_trial(df, "s", "n", minimize=False).first().n == 1


def test_outliers_and_null_counts(spark):
    df = spark.createDataFrame([(1, 499.0), (2, 500.0), (3, None)], "n INT, MAE DOUBLE")
    assert [r.n for r in df.filter(F.col("MAE") < 500).collect()] == [1]
    assert {r.column: r.nulls for r in reports.null_counts(df, ["n", "MAE"]).collect()} == {"n": 0, "MAE": 1}
