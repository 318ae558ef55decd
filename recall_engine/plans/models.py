"""Three classifiers of "is the word known", each a fitted preprocessing plus a Spark ML pipeline.

A fitted model scores any frame with the feature columns and keeps all its rows' columns beside
``y_pred`` and ``y_proba``, so nothing is re-attached by position.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.operators import metrics, prep
from recall_engine.operators.oversampling import smote
from recall_engine.plans import newton
from recall_engine.plans.rounds import boost
from recall_engine.schemas import FEATURES, FeatureSpec
from recall_engine.staging import stage

ORDER = "id_historical_data"
MISSING = -1_000.0  # stands for "unknown" in tree models, outside the range of every feature


# --- M1 ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PriorModel:
    """The share of positives as everyone's probability, the majority as everyone's label."""

    share: float

    @classmethod
    def fit(cls, dataset: DataFrame, spec: FeatureSpec = FEATURES) -> PriorModel:
        return cls(float(dataset.agg(F.avg(spec.target)).first()[0]))

    def predict(self, dataset: DataFrame) -> DataFrame:
        # With as many positives as negatives the smaller label wins.
        return dataset.withColumns(
            {"y_pred": F.lit(1.0 if self.share > 0.5 else 0.0), "y_proba": F.lit(self.share)}
        )


# --- settings ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LogisticSettings:
    """L2 with inverse strength ``c``; scaled inputs; the ``keep`` best features."""

    c: float = 10.0
    l1: bool = False
    max_iter: int = 1_000
    scale: bool = True
    keep: int | None = 11
    components: int | None = None
    oversample: bool = False
    seed: int = 0


@dataclass(frozen=True)
class BoostingSettings:
    """Many small steps. Trees here grow by level; Spark takes a depth of at most 30.

    With validation rows training stops once ``patience`` further trees have not lowered the loss on them, and the
    trees up to the best are kept. ``elimination_trees`` is how many trees judge the features (None: ``trees``).
    ``max_leaves`` is kept by the depth: a tree of d levels has at most 2 ** d leaves. The rows of a tree change every
    ``bagging_frequency`` trees; with 0 every tree has all rows.
    """

    trees: int = 1_000
    learning_rate: float = 0.002
    max_depth: int = 10
    feature_fraction: float = 0.75
    row_fraction: float = 0.75
    patience: int = 30
    max_leaves: int | None = None
    bagging_frequency: int = 400
    elimination_trees: int | None = None
    oversample: bool = False
    scale: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.max_depth <= 30:
            raise ValueError(f"max_depth {self.max_depth}: trees can be 0 to 30 deep")
        if self.max_leaves is not None and self.max_leaves < 1:
            raise ValueError("a tree has a leaf")

    @property
    def depth(self) -> int:
        """The most levels that keep both bounds."""
        return self.max_depth if self.max_leaves is None else min(self.max_depth, self.max_leaves.bit_length() - 1)


@dataclass
class FittedModel:
    """Preprocessing values, the inputs in use, and the Spark ML part."""

    kind: str
    spec: FeatureSpec
    inputs: list[str]
    pipeline: PipelineModel
    one_hot: prep.OneHot | None = None
    index: dict[str, dict] | None = None
    scaler: prep.Scaler | None = None
    fill: float | None = None
    ranking: list[tuple[str, int]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # held-out loss after each fitted tree
    fits: int = 0  # trees that were fitted, kept or not

    def preprocess(self, dataset: DataFrame) -> DataFrame:
        ready = prep.impute(dataset)
        if self.one_hot:
            ready = self.one_hot.transform(ready)
        if self.index:
            ready = prep.apply_inline_index(ready, self.index)
        if self.scaler:
            ready = self.scaler.transform(ready)
        if self.fill is not None:
            ready = ready.fillna(self.fill, subset=self.inputs)
        return ready

    def predict(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with ``y_pred`` and ``y_proba``.

        Rows with a category unseen in training cannot be indexed: :meth:`rejected` has those that a tree model leaves out.
        """
        raw = [c for c in dataset.columns]
        keep = F.struct(*[F.col(c) for c in raw]).alias("_row")
        ready = self.preprocess(dataset.select("*", keep))
        scored = self.pipeline.transform(ready)
        return scored.select(
            "_row.*",
            F.col("prediction").alias("y_pred"),
            F.get(vector_to_array("probability"), F.lit(1)).alias("y_proba"),
        )

    def rejected(self, dataset: DataFrame) -> DataFrame:
        """The rows that ``predict`` leaves out, unchanged."""
        if not self.index:
            return dataset.limit(0)
        row = F.struct("*").alias("_row")
        coded = prep.inline_codes(prep.impute(dataset.select("*", row)), self.index)
        missing = reduce(or_, [F.col(c).isNull() for c in self.index])
        return coded.filter(missing).select("_row.*")

    def evaluate(self, dataset: DataFrame) -> DataFrame:
        """All metrics on rows with a known target, as (metric, value)."""
        return metrics.evaluate(self.predict(dataset).withColumn("y_true", F.col(self.spec.target)))

    def coefficients(self) -> DataFrame:
        """(var, coef) of a logistic model, sorted by coefficient."""
        classifier = self.pipeline.stages[-1]
        spark = SparkSession.active()
        rows = list(zip(self.inputs, [float(x) for x in classifier.coefficients]))
        return spark.createDataFrame(rows, "var STRING, coef DOUBLE").orderBy("coef", "var")

    def save(self, path: str) -> None:
        """Write the pipeline and, as one JSON line beside it, the preprocessing values."""
        spark = SparkSession.active()
        state = {
            "kind": self.kind,
            "spec": asdict(self.spec),
            "inputs": self.inputs,
            "one_hot": asdict(self.one_hot) if self.one_hot else None,
            "index": self.index,
            "scaler": self.scaler.moments if self.scaler else None,
            "fill": self.fill,
            "ranking": self.ranking,
            "losses": self.losses,
            "fits": self.fits,
        }
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        line = spark.createDataFrame([(json.dumps(state),)], "value STRING")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/preprocessing")

    @classmethod
    def load(cls, path: str) -> FittedModel:
        spark = SparkSession.active()
        state = json.loads(spark.read.text(f"{path}/preprocessing").first()[0])
        spec = FeatureSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in state["spec"].items()})
        one_hot = prep.OneHot(**state["one_hot"]) if state["one_hot"] else None
        scaler = prep.Scaler({c: tuple(m) for c, m in state["scaler"].items()}) if state["scaler"] else None
        return cls(
            state["kind"],
            spec,
            state["inputs"],
            PipelineModel.load(f"{path}/pipeline"),
            one_hot,
            state["index"],
            scaler,
            state["fill"],
            [tuple(r) for r in state["ranking"]],
            state.get("losses", []),
            state.get("fits", 0),
        )


# --- logistic regression ----------------------------------------------------------------------------


def logistic(settings: LogisticSettings, rows: int, features: str = "features") -> LogisticRegression:
    """The Spark form of an inverse penalty: the loss is a mean here, so the penalty is 1 / (C n)."""
    return LogisticRegression(
        featuresCol=features,
        labelCol="label",
        regParam=1.0 / (settings.c * max(rows, 1)),
        elasticNetParam=1.0 if settings.l1 else 0.0,
        standardization=False,
        maxIter=settings.max_iter,
        tol=1e-6,
    )


def prepare_logistic(
    dataset: DataFrame, settings: LogisticSettings, spec: FeatureSpec = FEATURES
) -> tuple[DataFrame, prep.OneHot, prep.Scaler | None, list[str]]:
    """Imputed, encoded, optionally oversampled and scaled rows, with the encoders and input names."""
    ready = prep.impute(dataset.filter(F.col(spec.target).isNotNull()))
    one_hot = prep.OneHot.fit(ready, spec.boolean + spec.categorical)
    inputs = [*spec.numerical, *spec.diff_time, *one_hot.outputs]
    ready = one_hot.transform(ready).select(*inputs, F.col(spec.target).cast("double").alias("label"))
    if settings.oversample:
        ready = smote(ready.fillna(0.0, subset=inputs), inputs, "label", seed=settings.seed)
    scaler = None
    if settings.scale:
        scaler = prep.Scaler.fit(ready, inputs)
        ready = scaler.transform(ready)
    # Unknown after scaling means average.
    return ready.fillna(0.0, subset=inputs), one_hot, scaler, inputs


def fit_logistic(
    dataset: DataFrame, settings: LogisticSettings = LogisticSettings(), spec: FeatureSpec = FEATURES
) -> FittedModel:
    if settings.components and not settings.scale:
        raise ValueError("scaling comes before PCA")
    ready, one_hot, scaler, inputs = prepare_logistic(dataset, settings, spec)
    # Every iteration reads these rows again.
    training = stage(VectorAssembler(inputCols=inputs, outputCol="all").transform(ready).select("all", "label"), "training")
    rows = training.count()
    steps: list = []
    ranking: list[tuple[str, int]] = []
    used = inputs
    if settings.components:
        steps = [
            VectorAssembler(inputCols=inputs, outputCol="all"),
            PCA(k=settings.components, inputCol="all", outputCol="features"),
        ]
    else:
        if settings.keep and settings.keep < len(inputs):
            ranking = eliminate_features(training, inputs, settings.keep, logistic(settings, rows, "kept"))
            used = [name for name, rank in ranking if rank == 1]
        steps = [VectorAssembler(inputCols=used, outputCol="features")]
    staged = ready if settings.components else _vectors(training, inputs, used)
    if settings.components:
        pipeline = Pipeline(stages=[*steps, logistic(settings, rows)]).fit(ready)
    else:
        classifier = logistic(settings, rows).fit(staged)
        pipeline = PipelineModel(stages=[steps[0], classifier])
    return FittedModel(
        "logistic_regression", spec, used, pipeline, one_hot=one_hot, scaler=scaler, fill=0.0, ranking=ranking
    )


def _vectors(training: DataFrame, inputs: list[str], used: list[str]) -> DataFrame:
    if used == inputs:
        return training.withColumn("features", F.col("all"))
    slicer = VectorSlicer(inputCol="all", outputCol="features", indices=[inputs.index(c) for c in used])
    return slicer.transform(training)


def eliminate_features(
    training: DataFrame, names: Sequence[str], keep: int, classifier, step: int | float = 1
) -> list[tuple[str, int]]:
    """Recursive elimination: refit and drop the least important input until ``keep`` are left.

    ``training`` has the vector ``all``; importance is the squared weight, or what a tree model reports.
    ``step`` is how many inputs a round drops, as a number or a share. Returns (name, rank); kept ones
    have rank 1, the last dropped one rank 2. The loop runs over fits, never over rows. A logistic classifier that
    runs to its optimum is fitted in Newton steps, each round from the weights of the one before.
    """
    left = list(range(len(names)))
    dropped: list[list[int]] = []
    width = step if step >= 1 else max(1, int(step * len(names)))
    if len(left) > keep and newton.reaches_optimum(classifier):
        dropped = newton.eliminate(training, len(names), keep, classifier.getRegParam(), int(width), classifier.getLabelCol()) or []
        gone = {i for group in dropped for i in group}
        left = [i for i in left if i not in gone]
    while len(left) > keep:
        sliced = VectorSlicer(inputCol="all", outputCol="kept", indices=left).transform(training)
        fitted = classifier.fit(sliced)
        if hasattr(fitted, "featureImportances"):
            weights = fitted.featureImportances.toArray()
        else:
            weights = fitted.coefficients.toArray() ** 2
        order = sorted(range(len(left)), key=lambda i: (weights[i], i))
        out = {left[i] for i in order[: min(int(width), len(left) - keep)]}
        dropped.append(sorted(out))
        left = [i for i in left if i not in out]
    ranks = {i: 1 for i in left}
    for distance, group in enumerate(reversed(dropped)):
        ranks.update({i: distance + 2 for i in group})
    return [(name, ranks[i]) for i, name in enumerate(names)]


# --- boosting ---------------------------------------------------------------------------------------


def boosting(settings: BoostingSettings, features: str = "features") -> GBTClassifier:
    """What judges inputs in their elimination."""
    return GBTClassifier(
        featuresCol=features,
        labelCol="label",
        maxIter=settings.trees,
        stepSize=settings.learning_rate,
        maxDepth=settings.depth,
        featureSubsetStrategy=str(settings.feature_fraction),
        subsamplingRate=settings.row_fraction,
        seed=settings.seed,
        # Node ids of deep trees are kept in executor memory only where the cluster allows it.
        cacheNodeIds=False,
        maxMemoryInMB=512,
    )


def best_prefix(losses: Sequence[float], patience: int) -> int:
    """Number of trees up to the smallest loss seen before ``patience`` trees in a row brought no smaller one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


@dataclass
class BoostingRows:
    """Encoded rows, written once for any number of trainings (``all``, ``label``, ``tag``), and what encoded them."""

    train: DataFrame
    held: DataFrame | None
    inputs: list[str]
    index: dict[str, dict]
    scaler: prep.Scaler | None
    spec: FeatureSpec


def row_tag(rows: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def prepare_boosting(
    dataset: DataFrame,
    valid: DataFrame | None = None,
    spec: FeatureSpec = FEATURES,
    oversample: bool = False,
    scale: bool = False,
    seed: int = 0,
    tag: str | None = None,
) -> BoostingRows:
    """Encoders are fitted on ``dataset`` alone; the tag is a hash of a whole row, so equal rows share one (or a column that has it)."""
    codes = spec.boolean + spec.categorical
    ready = prep.impute(dataset.filter(F.col(spec.target).isNotNull()))
    # A tree model carries the codes of its inputs with it, whatever their number.
    inline = prep.LabelIndex.fit(ready, codes, ORDER, most_inline=None).as_inline()
    inputs = [*spec.numerical, *spec.diff_time, *codes]
    whole = F.col(tag) if tag else row_tag(dataset)

    def encode(rows: DataFrame) -> DataFrame:
        tagged = rows.withColumn("_tag", whole)
        coded = prep.apply_inline_index(prep.impute(tagged), inline)
        label = F.col(spec.target).cast("double").alias("label")
        return coded.select(*inputs, label, "_tag").fillna(MISSING, subset=inputs)

    rows = encode(dataset.filter(F.col(spec.target).isNotNull()))
    if oversample:
        rows = smote(rows, inputs, "label", seed=seed).withColumn("_tag", F.xxhash64(*inputs, "label"))
    scaler = None
    if scale:
        scaler = prep.Scaler.fit(rows, inputs)
        rows = scaler.transform(rows)
    assembler = VectorAssembler(inputCols=inputs, outputCol="all")
    written = [F.col("all"), F.col("label"), F.col("_tag").alias("tag")]
    train = stage(assembler.transform(rows).select(*written), "training")
    held = None
    if valid is not None:
        held = encode(valid.filter(F.col(spec.target).isNotNull()))
        held = stage(assembler.transform(scaler.transform(held) if scaler else held).select(*written), "held")
    return BoostingRows(train, held, inputs, inline, scaler, spec)


def train_boosting(rows: BoostingRows, settings: BoostingSettings, keep: int | None = None) -> FittedModel:
    """Trees on prepared rows; how they were prepared goes into the model."""
    used, ranking = rows.inputs, []
    if keep:
        judge = boosting(replace(settings, trees=settings.elimination_trees or settings.trees), "kept")
        ranking = eliminate_features(rows.train, rows.inputs, keep, judge)
        used = [name for name, rank in ranking if rank == 1]
    held = None if rows.held is None else _vectors(rows.held, rows.inputs, used).drop("all")
    done = boost(_vectors(rows.train, rows.inputs, used).drop("all"), settings, held)
    pipeline = PipelineModel(stages=[VectorAssembler(inputCols=used, outputCol="features"), done.model])
    return FittedModel(
        "gradient_boosting",
        rows.spec,
        used,
        pipeline,
        index=rows.index,
        scaler=rows.scaler,
        fill=MISSING,
        ranking=ranking,
        losses=done.losses,
        fits=done.fits,
    )


def score_held(fitted: FittedModel, rows: BoostingRows) -> DataFrame:
    """``y_true`` and ``y_pred`` of the held-out rows, which are encoded already: as ``predict`` of the rows with a target."""
    scored = fitted.pipeline.stages[-1].transform(_vectors(rows.held, rows.inputs, fitted.inputs))
    return scored.select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def fit_boosting(
    dataset: DataFrame,
    settings: BoostingSettings = BoostingSettings(),
    valid: DataFrame | None = None,
    spec: FeatureSpec = FEATURES,
    keep: int | None = None,
) -> FittedModel:
    """Train on ``dataset``; ``valid`` rows stop the training early. ``keep`` eliminates features first."""
    rows = prepare_boosting(dataset, valid, spec, settings.oversample, settings.scale, settings.seed)
    return train_boosting(rows, settings, keep)


# --- components -------------------------------------------------------------------------------------


def principal_components(dataset: DataFrame, inputs: Sequence[str], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """Scaled inputs projected on their first ``n`` components, columns ``component_01``, ... (sign is free)."""
    scaled = prep.Scaler.fit(dataset, inputs).transform(dataset)
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="_v").transform(scaled).select(*keep, "_v")
    projected = PCA(k=n, inputCol="_v", outputCol="_pc").fit(vectors).transform(vectors)
    values = vector_to_array("_pc")
    return projected.select(*keep, *[F.get(values, F.lit(i)).alias(f"component_{i + 1:02d}") for i in range(n)])


def explained_variance(components: DataFrame, names: Sequence[str]) -> DataFrame:
    """(component, ratio): population variance of each component over their sum."""
    spread = components.agg(*[F.var_pop(c).alias(c) for c in names])
    long = spread.unpivot([], list(names), "component", "variance")
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return long.select("component", (F.col("variance") / spread.select(total).scalar()).alias("ratio"))


__all__ = [
    "BoostingSettings",
    "FittedModel",
    "LogisticSettings",
    "PriorModel",
    "eliminate_features",
    "explained_variance",
    "fit_boosting",
    "fit_logistic",
    "principal_components",
]
