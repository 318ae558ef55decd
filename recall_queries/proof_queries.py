"""What must hold for trained models whatever their scores: keys, optima, round trips and re-derived values.

SQL cannot train a model, but it can name the rows a model has to score and the moments its components must have.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_queries import model_queries, vocab_queries
from recall_queries.dataset_queries import D3_SQL, SPLIT_SQL
from recall_queries.model_queries import ID, INPUTS, boosted, logistic_model, model_inputs, split_rows
from recall_queries.registry import query
from recall_queries.views import VOCAB_SQL
from recall_engine.operators import prep
from recall_engine.plans import models
from recall_engine.schemas import FEATURES
from recall_engine.staging import new_path, stage

SCALED = [*FEATURES.numerical, *FEATURES.diff_time]


def _weighted(values: dict[str, float]) -> Column:
    """The sum of weighted columns."""
    terms = [F.col(c) * F.lit(w) for c, w in values.items()]
    return F.aggregate(F.array(*terms), F.lit(0.0), lambda t, v: t + v)


def _margin(model: models.FittedModel) -> Column:
    weights = {r["var"]: r["coef"] for r in model.coefficients().collect()}  # one row an input
    return _weighted(weights) + F.lit(float(model.pipeline.stages[-1].intercept))


# --- logistic regression ----------------------------------------------------------------------------


@query(
    "m2_gradient_at_the_optimum",
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in (*SCALED, *FEATURES.boolean, *FEATURES.categorical, "intercept")) + "]) AS variable, 0.0E0 AS gradient",
)
def m2_gradient(spark, sf):
    """The gradient of the penalised mean loss over the training rows, to 3 digits; of a coded variable the largest of its columns."""
    rows = split_rows(spark, sf)
    model = logistic_model(spark, sf, rows)
    train = rows.filter("split = 'train'")
    ready = model.preprocess(train).withColumn("_error", 1 / (1 + F.exp(-_margin(model))) - F.col("result"))
    parts = [F.avg(F.col("_error") * F.col(c)).alias(c) for c in model.inputs]
    slopes = ready.agg(F.avg("_error").alias("intercept"), *parts).unpivot([], ["intercept", *model.inputs], "var", "slope")
    penalty = 1.0 / (models.LogisticSettings().c * train.count())
    joined = slopes.join(model.coefficients(), "var", "left")
    gradient = F.abs(F.col("slope") + penalty * F.coalesce("coef", F.lit(0.0)))
    return joined.groupBy(F.substring_index("var", "__", 1).alias("variable")).agg(F.round(F.max(gradient), 3).alias("gradient"))


@query(
    "m3_scores_from_coefficients",
    f"WITH {SPLIT_SQL} SELECT id_historical_data, 0.0E0 AS difference FROM fx_split WHERE split = 'test'",
)
def m3_scores(spark, sf):
    """The table of coefficients alone gives every probability again."""
    rows = split_rows(spark, sf)
    model = logistic_model(spark, sf, rows)
    scored = model.preprocess(model.predict(rows.filter("split = 'test'")))
    again = 1 / (1 + F.exp(-_margin(model)))
    return scored.select(ID, F.abs(F.col("y_proba") - again).alias("difference"))


@query(
    "s9_saved_model_scores_alike",
    f"WITH {SPLIT_SQL} SELECT id_historical_data, 0.0E0 AS difference, TRUE AS same_label FROM fx_split WHERE split = 'test'",
)
def s9_alike(spark, sf):
    rows = split_rows(spark, sf)
    path = new_path(spark, "model")
    model = logistic_model(spark, sf, rows)
    model.save(path)
    before = model.predict(rows.filter("split = 'test'")).select(ID, F.col("y_proba").alias("p"), F.col("y_pred").alias("label"))
    after = models.FittedModel.load(path).predict(rows.filter("split = 'test'")).select(ID, "y_proba", "y_pred")
    return before.join(after, ID).select(ID, F.abs(F.col("p") - F.col("y_proba")).alias("difference"), (F.col("label") == F.col("y_pred")).alias("same_label"))


# --- boosting ---------------------------------------------------------------------------------------


@query(
    "m4_scores_from_trees",
    f"WITH {SPLIT_SQL} SELECT id_historical_data, 0.0E0 AS difference FROM fx_split WHERE split = 'test'",
)
def m4_scores(spark, sf):
    """Every tree applied on its own; their weighted sum gives the probability again."""
    rows = split_rows(spark, sf)
    model = boosted(rows)
    assembler, ensemble = model.pipeline.stages
    scored = assembler.transform(model.preprocess(model.predict(rows.filter("split = 'test'"))))
    shares = {}
    for number, (tree, weight) in enumerate(zip(ensemble._java_obj.trees(), ensemble.treeWeights, strict=True)):
        one = DecisionTreeRegressionModel(tree).setFeaturesCol("features").setPredictionCol(f"_tree_{number}")
        scored = one.transform(scored)
        shares[f"_tree_{number}"] = float(weight)
    again = 1 / (1 + F.exp(-2 * _weighted(shares)))
    return scored.select(ID, F.abs(F.col("y_proba") - again).alias("difference"))


@query(
    "m5_labels_follow_scores",
    f"""WITH {SPLIT_SQL} SELECT id_historical_data, result AS y_true, TRUE AS in_range, TRUE AS label_follows
    FROM fx_split WHERE split = 'test'""",
)
def m5_labels(spark, sf):
    scored = model_queries.m5(spark, sf)
    p = F.col("y_proba")
    return scored.select(ID, "y_true", p.between(0, 1).alias("in_range"), ((p > 0.5) == (F.col("y_pred") == 1)).alias("label_follows"))


#: Metrics that Spark ML computes too: its name, and the label that it is about.
SPARK_METRICS = {
    "accuracy": ("accuracy", None),
    "recall": ("recallByLabel", 1.0),
    "precision": ("precisionByLabel", 1.0),
    "fall_out": ("falsePositiveRateByLabel", 1.0),
    "f1_score": ("fMeasureByLabel", 1.0),
    "specificity": ("recallByLabel", 0.0),
    "mean_absolute_error": ("mae", None),
    "root_mean_squared_error": ("rmse", None),
    "brier_score": ("mse", None),
    "r2_score": ("r2", None),
}


@query("m6_metrics_as_spark_ml", f"SELECT unnest([{', '.join(map(repr, SPARK_METRICS))}]) AS metric, 0.0E0 AS difference")
def m6_metrics(spark, sf):
    """Metrics of a trained model beside Spark ML's own on the same scored rows."""
    rows = split_rows(spark, sf)
    test = rows.filter("split = 'test'")
    model = boosted(rows)
    scored = stage(model.predict(test).select("result", "y_pred", "y_proba"), "scored")

    def theirs(name: str, label: float | None) -> float:
        if name in ("mae", "rmse", "mse", "r2"):
            return RegressionEvaluator(labelCol="result", predictionCol="y_proba", metricName=name).evaluate(scored)
        judge = MulticlassClassificationEvaluator(labelCol="result", predictionCol="y_pred", metricName=name)
        return (judge if label is None else judge.setMetricLabel(label)).evaluate(scored)

    values = spark.createDataFrame([(n, theirs(*how)) for n, how in SPARK_METRICS.items()], "metric STRING, theirs DOUBLE")
    ours = model.evaluate(test).join(values, "metric")
    return ours.select("metric", F.abs(F.col("value") - F.col("theirs")).alias("difference"))


# --- components and elimination ---------------------------------------------------------------------

#: Sum of the squared correlations of all inputs with each other, and the number of inputs that vary.
CORRELATED_SQL = f"""{D3_SQL}, fx_numbers AS (
    SELECT {', '.join(f'{model_queries._number_sql(c)} AS {c}' for c in INPUTS)} FROM fx_features JOIN fx_vocab_features USING (id_vocab)
), fx_deviations AS (
    SELECT {', '.join(f'stddev_pop({c}) AS s_{c}' for c in INPUTS)} FROM fx_numbers
), fx_squares AS (
    SELECT {' + '.join(f'CASE WHEN s_{c} > 0 THEN 1.0E0 ELSE 0.0E0 END' for c in INPUTS)} AS inputs,
      2 * ({' + '.join(f'CASE WHEN s_{a} > 0 AND s_{b} > 0 THEN (v_{i} / (s_{a} * s_{b})) ** 2 ELSE 0.0E0 END' for i, (a, b) in enumerate(combinations(INPUTS, 2)))}) AS pairs
    FROM fx_deviations, (SELECT {', '.join(f'covar_pop({a}, {b}) AS v_{i}' for i, (a, b) in enumerate(combinations(INPUTS, 2)))} FROM fx_numbers)
)"""


def _components(spark, sf) -> tuple[DataFrame, list[str]]:
    components = stage(models.principal_components(model_inputs(spark, sf), INPUTS, len(INPUTS)), "components")
    return components, components.columns


@query(
    "p7_components_of_all_inputs",
    f"""WITH {CORRELATED_SQL} SELECT round(inputs, 4) AS total_variance, round(inputs + pairs, 4) AS squared_variances,
      TRUE AS descending FROM fx_squares""",
)
def p7_all(spark, sf):
    """All 38 components, in order of their variances.

    A rotation keeps the sum of all squared covariances; only uncorrelated components have it in their variances alone.
    """
    components, names = _components(spark, sf)
    variances = [F.var_pop(c) for c in names]
    total = lambda terms: F.aggregate(F.array(*terms), F.lit(0.0), lambda t, v: t + v)
    falling = F.array_min(F.array(*[a - b for a, b in zip(variances, variances[1:])])) > -1e-9
    return components.agg(
        F.round(total(variances), 4).alias("total_variance"),
        F.round(total([v * v for v in variances]), 4).alias("squared_variances"),
        falling.alias("descending"),
    )


@query(
    "f27_explained_variance_of_all_inputs",
    f"WITH {CORRELATED_SQL} SELECT CAST(38 AS BIGINT) AS components, 1.0E0 AS total, round((inputs + pairs) / (inputs * inputs), 5) AS concentration FROM fx_squares",
)
def f27_all(spark, sf):
    shares = models.explained_variance(*_components(spark, sf))
    return shares.agg(
        F.count(F.lit(1)).alias("components"), F.sum("ratio").alias("total"), F.round(F.sum(F.col("ratio") ** 2), 5).alias("concentration")
    )


@query(
    "p8_ranks_of_all_inputs",
    "SELECT CAST(r AS BIGINT) AS rank, CAST(CASE r WHEN 1 THEN 4 ELSE 1 END AS BIGINT) AS inputs, TRUE AS weakest FROM range(1, 36) t(r)",
)
def p8_all(spark, sf):
    """Elimination over all 38 inputs. ``weakest``: of the inputs left at its round, the dropped one weighs least in a fit of its own."""
    rows = stage(model_inputs(spark, sf), "inputs")
    scaled = prep.Scaler.fit(rows, INPUTS).transform(rows)
    vectors = VectorAssembler(inputCols=INPUTS, outputCol="all").transform(scaled)
    training = stage(vectors.select("all", F.col("result").alias("label")), "rfe")
    classifier = models.logistic(models.LogisticSettings(), training.count(), "kept")
    ranking = models.eliminate_features(training, INPUTS, 4, classifier)
    first = max(r for _, r in ranking)
    weights = models.logistic(models.LogisticSettings(), training.count(), "all").fit(training).coefficients.toArray() ** 2
    least = INPUTS[min(range(len(INPUTS)), key=lambda i: (weights[i], i))]
    table = spark.createDataFrame(ranking, "feature STRING, rank INT")
    weakest = F.bool_and((F.col("rank") != first) | (F.col("feature") == least))
    return table.groupBy("rank").agg(F.count(F.lit(1)).alias("inputs"), weakest.alias("weakest"))


# --- the scored session and the schemas -------------------------------------------------------------

WORDS_SQL = vocab_queries.FEATURES_SQL.replace(VOCAB_SQL + ", ", "", 1)


@query(
    "d6_every_graded_word_once",
    f"""WITH {SPLIT_SQL}, {WORDS_SQL} SELECT DISTINCT learner_id, id_vocab, TRUE AS in_range FROM fx_tries
    WHERE id_vocab IN (SELECT id_vocab FROM fx_vocab_features WHERE difficulty_category IS NOT NULL)""",
)
def d6_keys(spark, sf):
    """Every learner has both probabilities of each graded word they have met, once."""
    both = F.col("english_proba").between(0, 1) & F.col("german_proba").between(0, 1)
    return model_queries.d6(spark, sf).select("learner_id", "id_vocab", F.coalesce(both, F.lit(False)).alias("in_range"))
