"""Models on data with a known structure; neighbours against brute force."""

import inspect

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recall_queries import dataset_queries, views
from recall_engine.operators import datasets, oversampling, prep, reports
from recall_engine.operators.global_order import dense_id
from recall_engine.plans import models, newton, rounds, search
from recall_engine.schemas import FeatureSpec
from recall_engine.staging import stage


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    data = datasets.split_by_session(dataset_queries.training_set(spark, sf_dir), views.LEARNER)
    return stage(data, "dataset")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(400, 3)
    x[100:250] = x[0]  # a third of the rows are copies
    label = (x[:, 0] + 0.5 * x[:, 1] > 0.9).astype(float)
    return x, label, spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, label)], "a DOUBLE, b DOUBLE, c DOUBLE, label DOUBLE")


def test_prior_model(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (0.0,)], "result DOUBLE")
    got = models.PriorModel.fit(df).predict(df).first()
    assert got.y_pred == 1.0 and got.y_proba == pytest.approx(2 / 3)


def test_logistic_matches_a_direct_minimiser(points):
    """Same optimum as Newton steps on sum(loss) * C + |w|^2 / 2 with a free intercept."""
    x, y, df = points
    c = 0.5
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    fitted = models.logistic(models.LogisticSettings(c=c), len(y)).fit(vectors)
    design = np.hstack([x, np.ones((len(y), 1))])
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = c * design.T @ (p - y) + ridge @ w
        w -= np.linalg.solve(c * (design.T * (p * (1 - p))) @ design + ridge, gradient)
    assert fitted.coefficients.toArray() == pytest.approx(w[:3], abs=1e-3)
    assert fitted.intercept == pytest.approx(w[3], abs=1e-3)


def test_elimination_drops_noise_first(points):
    _, _, df = points
    noisy = df.withColumn("noise", F.rand(1) * 0.01)
    names = ["noise", "a", "c", "b"]
    training = VectorAssembler(inputCols=names, outputCol="all").transform(noisy).select("all", "label")
    ranking = dict(models.eliminate_features(training, names, 2, models.logistic(models.LogisticSettings(), 400, "kept")))
    assert ranking["a"] == ranking["b"] == 1 and {ranking["c"], ranking["noise"]} == {2, 3}


def test_elimination_by_newton_steps_ranks_as_fits_from_zero(spark):
    """The optimum of every round, in a few passes over the rows rather than a fit's worth of them."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 7))
    x[:, 5] = x[:, 0] + x[:, 1]  # no curvature of its own
    x[:, 6] = 0.0
    y = (x[:, :5] @ [3.0, -2.0, 1.0, 0.5, 0.25] + draw.logistic(size=600) > 1.0).astype(float)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"x{i} double" for i in range(7)) + ", label double")
    training = VectorAssembler(inputCols=[f"x{i}" for i in range(7)], outputCol="all").transform(rows).select("all", "label")
    classifier = models.logistic(models.LogisticSettings(), 600, "kept")
    assert newton.reaches_optimum(classifier) and not newton.reaches_optimum(models.logistic(models.LogisticSettings(max_iter=20), 600))
    curved = newton.Curved(training, 7, classifier.getRegParam())
    weights, _ = curved.optimum(range(7), np.zeros(8))
    fitted = classifier.copy().setFeaturesCol("all").setTol(1e-12).fit(training)
    assert weights == pytest.approx([*fitted.coefficients.toArray(), fitted.intercept], abs=1e-4) and curved.passes < 12
    left, ranks = list(range(7)), {}
    while len(left) > 1:
        part = VectorSlicer(inputCol="all", outputCol="kept", indices=left).transform(training)
        found = classifier.fit(part).coefficients.toArray() ** 2
        ranks[left.pop(min(range(len(left)), key=lambda i: (found[i], i)))] = len(left)
    assert dict(models.eliminate_features(training, [f"x{i}" for i in range(7)], 1, classifier)) == {f"x{i}": r for i, r in (ranks | {left[0]: 1}).items()}


def with_an_answer(spark, rows, inputs, seed=3):
    """Numbers that are partly sums of each other, and labels by some of them."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(rows, inputs))
    x[:, -1] = x[:, 0] + x[:, 1]
    x[:, -2] = x[:, 2] + 0.05 * draw.normal(size=rows)
    y = (x[:, :3] @ [2.0, -1.0, 0.5] + draw.logistic(size=rows) > 0.5).astype(float)
    data = spark.createDataFrame([([*map(float, r)], float(t)) for r, t in zip(x, y)], "x array<double>, label double")
    return stage(data.select(array_to_vector("x").alias("all"), "label"), "answer")


def test_rows_of_an_elimination_are_written_one_by_one(spark):
    """A reader takes thousands of cells at a time: each has the numbers of one row, however many rows a task writes."""
    curved = newton.Curved(with_an_answer(spark, 3000, 6).coalesce(1), 6, 0.001)
    sizes = spark.read.parquet(curved.path).select(F.octet_length("cell").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert tuple(sizes) == (8 * 7, 3000) and (curved.rows, curved.odd) == (3000, 0) and curved.two_classes
    curved.end()


def test_unknown_labels_are_left_to_the_classifier(spark):
    training = with_an_answer(spark, 50, 6)
    for label in (F.lit(None).cast("double"), F.lit(2.0), F.lit(float("nan"))):
        odd = training.unionByName(training.limit(1).withColumn("label", label))
        curved = newton.Curved(odd, 6)
        assert curved.odd == 1 and not curved.two_classes and newton.eliminate(odd, 6, 2, 0.02, 1) is None
        curved.end()


def test_rounds_of_an_elimination_share_passes(spark, monkeypatch):
    training, taken = with_an_answer(spark, 800, 12), []
    counted = newton.Curved._pass
    monkeypatch.setattr(newton.Curved, "_pass", lambda self, points: taken.append(len(points)) or counted(self, points))
    dropped = newton.eliminate(training, 12, 2, 1 / 800, 1)
    together, taken[:] = len(taken), []
    monkeypatch.setattr(newton, "AHEAD", 1)
    assert dropped == newton.eliminate(training, 12, 2, 1 / 800, 1) and len(dropped) == 10
    assert together < 0.75 * len(taken)


@pytest.mark.parametrize("l1", [True, False])
def test_fits_of_a_grid_share_passes(spark, l1):
    """All penalties and choices reach their own optimum."""
    training, n = with_an_answer(spark, 700, 8), 700
    choices, penalties = [(0, 1, 2, 3), (1, 4, 6), tuple(range(8))], [1 / (c * n) for c in (0.01, 1.0, 100.0)]
    curved = newton.Curved(training, 8)
    found = newton.penalised_grid(curved, choices, penalties, l1)
    assert curved.passes < 30
    x, y = (np.array(v) for v in zip(*[(r[0].toArray(), r[1]) for r in training.collect()], strict=True))
    for left, some in zip(choices, found, strict=True):
        for penalty, w in zip(penalties, some, strict=True):
            a = np.column_stack([x[:, list(left)], np.ones(n)])
            pull = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / n
            assert pull[-1] == pytest.approx(0, abs=1e-5)
            if l1:  # the loss pulls a weight that is not zero as much as the penalty does, and others no more than that
                at, rest = pull[:-1][w[:-1] != 0], pull[:-1][w[:-1] == 0]
                assert at == pytest.approx(-penalty * np.sign(w[:-1][w[:-1] != 0]), abs=1e-5) and (np.abs(rest) <= penalty + 1e-5).all()
            else:
                assert pull[:-1] == pytest.approx(-penalty * w[:-1], abs=1e-5)
    curved.end()


def test_logistic_model_saves_and_loads(spark, rows, tmp_path):
    model = models.fit_logistic(rows.filter("split = 'train'"), models.LogisticSettings(keep=54, max_iter=30))
    held = rows.filter("split <> 'train'")
    before = model.predict(held)
    assert before.columns == [*held.columns, "y_pred", "y_proba"] and before.count() == held.count()
    assert len(model.inputs) == 54 and model.coefficients().count() == 54
    model.save(str(tmp_path / "m"))
    again = models.FittedModel.load(str(tmp_path / "m")).predict(held)
    assert before.select("id_historical_data", "y_proba").exceptAll(again.select("id_historical_data", "y_proba")).isEmpty()


def test_boosting_learns_and_keeps_rows(rows, tmp_path):
    settings = models.BoostingSettings(trees=5, learning_rate=0.5, max_depth=4)
    model = models.fit_boosting(rows.filter("split = 'train'"), settings, rows.filter("split = 'valid'"), keep=20)
    assert len(model.inputs) == 20
    train = rows.filter("split = 'train'")
    scored = model.predict(train)
    assert scored.count() == train.count()
    quality = {r.metric: r.value for r in model.evaluate(train).collect()}
    share = train.agg(F.avg("result")).first()[0]
    assert quality["accuracy"] > max(share, 1 - share)
    model.save(str(tmp_path / "m"))
    again = {r.metric: r.value for r in models.FittedModel.load(str(tmp_path / "m")).evaluate(train).collect()}
    assert again == pytest.approx(quality)


def test_unseen_category_leaves_the_row_out(rows):
    settings = models.BoostingSettings(trees=1, max_depth=2)
    model = models.fit_boosting(rows.filter("split = 'train'"), settings)
    strange = rows.limit(3).withColumn("language_asked", F.lit("french"))
    assert model.predict(strange).count() == 0
    mixed = strange.unionByName(rows.limit(2))
    assert model.rejected(mixed).count() == 3 and model.rejected(mixed).columns == mixed.columns
    assert model.predict(mixed).count() == 2


def test_early_stop_keeps_the_best_prefix_under_patience(rows):
    assert models.best_prefix([5, 4, 6, 6, 3, 9], 2) == 2
    assert models.best_prefix([5, 4, 6, 6, 3, 9], 3) == 5
    assert models.best_prefix([1.0], 30) == 1
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
    settings = models.BoostingSettings(trees=12, learning_rate=0.6, max_depth=4, patience=3)
    full = models.fit_boosting(train, settings)
    stopped = models.fit_boosting(train, settings, valid)
    held = full.preprocess(valid).withColumn("label", F.col("result").cast("double"))
    assembler, trees = full.pipeline.stages
    losses = trees.evaluateEachIteration(assembler.transform(held))
    best = models.best_prefix(losses, 3)
    assert stopped.pipeline.stages[-1].getNumTrees == best
    assert stopped.pipeline.stages[-1].evaluateEachIteration(assembler.transform(held)) == pytest.approx(losses[:best])
    assert full.fits == 12 and full.losses == []
    assert stopped.fits == min(best + 3, 12) and stopped.losses == pytest.approx(losses[: stopped.fits])


def test_rounds_end_while_training(rows):
    """Fits after the best tree are as many as the patience; the sum of trees is right beyond a written table."""
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
    settings = models.BoostingSettings(trees=60, learning_rate=0.9, max_depth=5, patience=12, bagging_frequency=2)
    model = models.fit_boosting(train, settings, valid)
    best = model.pipeline.stages[-1].getNumTrees
    assert model.fits == best + 12 < 60 and len(model.losses) == model.fits > rounds.ROUNDS_A_TABLE
    assert best == model.losses.index(min(model.losses)) + 1


def test_losses_are_taken_when_training_could_end(rows, monkeypatch):
    """One pass over the held-out rows where the patience is longer than the rounds; the losses are those of every round."""
    passes, taken = [], rounds._losses
    monkeypatch.setattr(rounds, "_losses", lambda *a: passes.append(len(a[1])) or taken(*a))
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
    model = models.fit_boosting(train, models.BoostingSettings(trees=4, learning_rate=0.6, max_depth=3), valid)
    assert passes == [4] and len(model.losses) == model.fits == 4
    held = model.preprocess(valid).withColumn("label", F.col("result").cast("double"))
    assembler, trees = model.pipeline.stages
    kept = trees.getNumTrees
    assert trees.evaluateEachIteration(assembler.transform(held)) == pytest.approx(model.losses[:kept])


def test_held_out_rows_score_as_predicted(rows):
    train, valid = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    valid = valid.withColumn("language_asked", F.when(F.col("id_historical_data") % 7 == 0, "french").otherwise(F.col("language_asked")))
    prepared = models.prepare_boosting(train, valid)
    fitted = models.train_boosting(prepared, models.BoostingSettings(trees=3, learning_rate=0.6, max_depth=3), keep=9)
    count = lambda df: sorted(map(tuple, df.groupBy("y_true", "y_pred").count().collect()))
    predicted = fitted.predict(valid.filter("result IS NOT NULL")).withColumn("y_true", F.col("result").cast("double"))
    assert count(models.score_held(fitted, prepared)) == count(predicted)


def test_folds_lie_in_folders(spark):
    """A fold is read without the rows of the others, and columns keep their order and type."""
    df = spark.createDataFrame([(0, "train", 1.5), (1, "train", 2.5), (1, "valid", None)], "fold INT, role STRING, x DOUBLE")
    staged = stage(df, "folds", folders=["fold", "role"])
    assert staged.schema == df.schema and sorted(map(tuple, staged.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    one = staged.filter("fold = 1 AND role = 'train'")
    assert len({r[0] for r in one.select(F.input_file_name()).collect()}) == 1
    assert "PartitionFilters: [isnotnull(fold" in one._jdf.queryExecution().toString()


def test_wide_rows_are_compiled(spark, sf_dir):
    """A query sets the limit on generated methods above which the JVM would not compile them."""
    from recall_queries import registry

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    registry.queries()["m1_prior_classifier"](spark, sf_dir)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_bags_and_leaves(spark):
    df = spark.range(4000).withColumn("tag", F.xxhash64("id"))
    taken = [
        {r.id for r in df.filter(rounds._bag(F.col("tag"), 0.75, frequency, 0, number)).collect()}
        for frequency, number in [(2, 0), (2, 1), (2, 2), (0, 0)]
    ]
    assert taken[0] == taken[1] != taken[2] and len(taken[3]) == 4000
    assert all(abs(len(t) - 3000) < 150 for t in taken[:3])
    depth = lambda leaves: models.BoostingSettings(max_depth=6, max_leaves=leaves).depth
    assert [depth(n) for n in (None, 1, 2, 3, 4, 63, 64, 1000)] == [6, 0, 1, 1, 2, 5, 6, 6]
    with pytest.raises(ValueError):
        models.BoostingSettings(max_leaves=0)


def test_nothing_held_out_stops_nothing(rows):
    train = rows.filter("split = 'train'")
    model = models.fit_boosting(train, models.BoostingSettings(trees=2, max_depth=1, patience=1), train.limit(0))
    assert model.fits == 2 and model.pipeline.stages[-1].getNumTrees == 2 and model.losses == []


def test_more_than_a_thousand_categories(rows):
    twice = rows.unionByName(rows.withColumn("id_historical_data", F.col("id_historical_data") + 1_000_000))
    wide = twice.withColumn("language_asked", F.concat("language_asked", F.lit("."), F.col("id_historical_data").cast("string")))
    assert wide.count() > 1000
    model = models.fit_boosting(wide, models.BoostingSettings(trees=1, max_depth=2))
    assert model.predict(wide).count() == wide.count()


def test_depth_beyond_the_limit_is_refused():
    with pytest.raises(ValueError):
        models.BoostingSettings(max_depth=450)


def test_components_and_explained_variance(spark, points):
    x, _, df = points
    got = models.principal_components(df, ["a", "b", "c"], 2)
    scaled = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(scaled.T, bias=True)))[::-1][:2]
    spread = got.agg(F.var_pop("component_01"), F.var_pop("component_02")).first()
    assert tuple(spread) == pytest.approx(tuple(values))
    ratio = {r.component: r.ratio for r in models.explained_variance(got, got.columns).collect()}
    assert sum(ratio.values()) == pytest.approx(1.0)
    assert ratio["component_01"] == pytest.approx(values[0] / values.sum())


def brute_neighbours(x, k):
    """Per point the (square, place) of the k closest others; ties by place."""
    full = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(full, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), full.shape), full), axis=1)[:, :k]
    return [[(full[i, j], j) for j in row if np.isfinite(full[i, j])] for i, row in enumerate(order)]


def as_points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "place long, x array<double>, copies long")


@pytest.mark.parametrize(("kind", "block"), [("spread", 8), ("grid", 16)])
def test_neighbours_are_exact(spark, kind, block):
    draw = np.random.default_rng(5)
    x = {
        "spread": lambda: draw.normal(size=(220, 5)) * [9, 4, 2, 1, 1],
        "grid": lambda: np.unique(draw.integers(0, 5, (400, 3)), axis=0).astype(float),
        "line": lambda: np.arange(200.0)[:, None] ** 2,
        "lumps": lambda: np.unique(draw.integers(0, 40, (260, 1)) * 1000 + draw.integers(0, 9, (260, 20)), axis=0).astype(float),
    }[kind]()
    draw.shuffle(x)
    got = {r.place: [(n.square, n.near) for n in r.nearest] for r in oversampling.nearest_neighbours(as_points(spark, x), 5, block).collect()}
    want = brute_neighbours(x, 5)
    assert len(got) == len(x)
    for i, found in enumerate(want):
        assert [s for s, _ in got[i]] == pytest.approx([s for s, _ in found])
        if kind != "spread":  # whole numbers have exact ties
            assert got[i] == found


def test_visits_carry_no_inputs_and_rough_distances_decide_nothing(spark):
    """Visits are numbers; far from the origin the expanded square is off by whole units, the neighbours are not."""
    draw = np.random.default_rng(11)
    x = np.unique(draw.integers(0, 6, (300, 3)), axis=0) + 1e6
    visits, _, found = oversampling._search(as_points(spark, x), 4, 16, None)
    assert set(visits.columns) == {"place", "home", "other"} and "x" not in found.select(F.inline("nearest")).columns
    got = {r.place: [(n.square, n.near) for n in r.nearest] for r in oversampling.nearest_neighbours(as_points(spark, x), 4, 16).collect()}
    assert [got[i] for i in range(len(x))] == brute_neighbours(x, 4)


def test_only_seekers_search_and_few_points_have_fewer(spark):
    x = np.arange(4.0)[:, None]
    points = as_points(spark, x)
    got = oversampling.nearest_neighbours(points, 5, 2, points.filter("place = 1")).collect()
    assert [(r.place, [n.near for n in r.nearest]) for r in got] == [(1, [0, 2, 3])]


def test_boxes_prune_visits_of_real_inputs(spark):
    """At 38 inputs a point is held against less than a fifth of the blocks."""
    from recall_queries.model_queries import INPUTS, model_inputs

    rows = model_inputs(spark, "/root/testdata/sf0.01").filter("result = 0").select(F.array(*INPUTS).alias("x"))
    points = stage(dense_id(rows.groupBy("x").agg(F.count("*").alias("copies")), ["x"], "place"), "points")
    visits, blocked, _ = oversampling._search(points, 5, 16, None)
    blocks, n = blocked.select("block").distinct().count(), points.count()
    assert len(INPUTS) == 38 and blocks > 200
    assert visits.count() + n * (oversampling.FIRST + 1) < 0.2 * n * blocks


def test_made_rows_lie_between_a_row_and_a_near_one(spark):
    """Copies count as neighbours at no distance; every row gives as often as any other, but for one."""
    draw = np.random.default_rng(8)
    x = draw.integers(0, 6, (60, 2)).astype(float)
    x[:9] = [100.0, 100.0]  # more copies than neighbours
    minority = spark.createDataFrame([([float(a), float(b)],) for a, b in x], "x array<double>")
    made = oversampling.made_rows(minority, 150, 5, 3, block_rows=16).collect()
    assert len(made) == 150
    given = {}
    for r in made:
        given[r.place, r.row] = given.get((r.place, r.row), 0) + 1
        others = sorted(((np.array(r.from_x) - y) ** 2).sum() for y in x)[1:]  # one of them is the row itself
        assert ((np.array(r.from_x) - r.near_x) ** 2).sum() <= others[4]
        assert r.x == pytest.approx([a + r.step * (b - a) for a, b in zip(r.from_x, r.near_x, strict=True)]) and 0 <= r.step < 1
        assert r.from_x != [100.0, 100.0] or r.x == [100.0, 100.0]
    assert sorted(set(given.values())) == [2, 3] and len(given) == 60 and sum(v == 3 for v in given.values()) == 30


def test_smote_balances_between_neighbours(points):
    x, label, df = points
    done = oversampling.smote(df, ["a", "b", "c"], "label", block_rows=16)
    counts = {r.label: r["count"] for r in done.groupBy("label").count().collect()}
    assert counts[0.0] == counts[1.0] == max((label == 0).sum(), (label == 1).sum())
    assert sorted(map(str, done.collect())) == sorted(map(str, oversampling.smote(df, ["a", "b", "c"], "label", block_rows=16).collect()))


def test_search_scores_every_trial_and_drops_trailing_ones(rows):
    folds = datasets.expanding_folds(rows.drop("split"), 2, 1, views.LEARNER)
    drawn = search.random_boosting_settings(3, seed=4, trees=1)
    # Deeper trees spread the probabilities more.
    trials = [models.replace(t, max_depth=d, max_leaves=None, feature_fraction=1.0, row_fraction=1.0) for t, d in zip(drawn, (1, 4, 2))]
    spread = lambda scored: float(scored.agg(F.var_pop("y_proba")).first()[0])
    table = search.search_boosting(folds, trials, spread)
    got = table.orderBy("number").collect()
    assert [r.number for r in got] == [0, 1, 2] and [r.state for r in got] == ["PRUNED", "COMPLETE", "COMPLETE"]
    assert [r.folds for r in got] == [1, 2, 2] == [r.fits for r in got]
    assert got[0].value is None and 0 < got[0].mean_so_far < got[2].value < got[1].value
    assert [r.params_max_depth for r in got] == [1, 4, 2] and all(r.datetime_start <= r.datetime_complete for r in got)
    assert reports.best_trial(table, "value", "number", minimize=False).first().number == 1
    means = {r.params_max_depth: r.n for r in reports.score_per_value(table, "params_max_depth", "value").collect()}
    assert means == {1: 0, 4: 1, 2: 1}
    assert reports.trial_duration(table).filter("duration_hour < 0").isEmpty()


def test_trailing_trials():
    assert search.still_in_it({0: [0.1], 1: [0.5], 2: [0.5], 3: [0.2]}) == [1, 2]
    assert search.still_in_it({0: [0.3, 0.1], 1: [0.2, 0.2]}) == [0, 1]
    assert search.still_in_it({0: [None], 1: [0.2]}) == [1] and search.still_in_it({0: [None]}) == []


def test_random_settings_draw_seven_parameters():
    drawn = search.random_boosting_settings(200, 1)
    assert drawn == search.random_boosting_settings(200, 1)
    for name in search.PARAMETERS:
        assert len({getattr(t, name) for t in drawn}) > 5, name
    assert all(t.depth <= 9 and 2 <= t.max_leaves <= 997 and 5 <= t.patience <= 100 for t in drawn)


def test_search_queries_take_the_whole_study(spark, monkeypatch):
    """1,000 trials of 1,000 trees at the depth they drew, none of them dropped before its five folds."""
    from recall_queries import dataset_queries, model_queries

    seen = {}
    tries = spark.createDataFrame([(1, n) for n in range(12)], "learner_id LONG, id_session LONG")
    monkeypatch.setattr(dataset_queries, "training_set", lambda spark, sf: tries)
    monkeypatch.setattr(search, "search_boosting", lambda folds, trials, **how: seen.update(how, folds=folds, trials=trials))
    model_queries.searched(spark, "unused")
    assert seen["trials"] == search.random_boosting_settings(1_000, seed=1) and {t.trees for t in seen["trials"]} == {1_000}
    assert max(t.max_depth for t in seen["trials"]) == 30 and seen["drop_trailing"] is False
    assert sorted(r.fold for r in seen["folds"].select("fold").distinct().collect()) == [0, 1, 2, 3, 4]


@pytest.fixture(scope="module")
def graded(points):
    """The points with an id, a category and a number that says nothing; y is in every third row only."""
    _, _, df = points
    spec = FeatureSpec("label", ("a", "b", "c", "noise"), (), (), ("kind",))
    numbered = dense_id(df, ["a", "b", "c", "label"], "id_historical_data")
    place = F.col("id_historical_data")
    kind = F.when(place % 5 == 4, F.when(place % 2 == 0, "late").otherwise("x")).when(place % 3 == 0, "y").otherwise("x")
    return stage(numbered.withColumns({"noise": place * 7919 % 97 / 97.0, "kind": kind}), "graded"), spec


def test_grid_serves_all_keeps_from_one_path_a_fold(graded):
    df, spec = graded
    fits, fold = search.GridFits(), (F.col("id_historical_data") % 3).cast("int")
    table = search.logistic_grid(df, (1.0, 50.0), (2, 3, 5), 3, spec=spec, max_iter=60, l1=False, fold=fold, fits=fits)
    got = {(r.keep, r.c): r for r in table.collect()}
    # kind gives x, y, late and missing: 8 inputs and 6 drops a path, but y is unknown outside fold 0; 6 classifiers a fold.
    assert (fits.eliminations, fits.projections, fits.classifiers) == (6 + 6 + 5, 0, 18) and len(got) == 6
    settings = models.LogisticSettings(c=50.0, max_iter=60)
    per_fold = []
    for n in range(3):
        mine, held = df.filter(fold != n), df.filter(fold == n)
        ready, one_hot, scaler, inputs = models.prepare_logistic(mine, settings, spec)
        training = VectorAssembler(inputCols=inputs, outputCol="all").transform(ready).select("all", "label")
        judge = models.logistic(models.LogisticSettings(c=1.0, max_iter=60), training.count(), "kept")
        used = [name for name, rank in models.eliminate_features(training, inputs, 3, judge) if rank == 1]
        assembler = VectorAssembler(inputCols=used, outputCol="features")
        model = models.logistic(settings, training.count()).fit(assembler.transform(ready))
        coded = scaler.transform(one_hot.transform(held)).fillna(0.0, subset=inputs)
        per_fold.append(model.transform(assembler.transform(coded)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    row = got[3, 50.0]
    assert [row.split0_test_score, row.split1_test_score, row.split2_test_score] == pytest.approx(per_fold)
    assert row.mean_test_score == pytest.approx(np.mean(per_fold)) and row.std_test_score == pytest.approx(np.std(per_fold))
    assert min(r.rank_test_score for r in got.values()) == 1 and row.mean_test_score > 0.9


def test_grid_axes(graded):
    df, spec = graded
    fits = search.GridFits()
    table = search.logistic_grid(
        df, (10.0,), (3,), 2, spec=spec, max_iter=30, samplings=("None", "SMOTE"), reductions=("None", "PCA"),
        selections=(True, False), components=(1, 2), fits=fits,
    )
    got = [(r.sampling, r.dimension_reduction, r.feature_selection, r.components, r.keep) for r in table.collect()]
    each = [("None", True, None, 3), ("None", False, None, None), ("PCA", False, 1, None), ("PCA", False, 2, None)]
    assert sorted(map(str, got)) == sorted(str((s, *e)) for s in ("None", "SMOTE") for e in each)
    assert fits.projections == 4 and fits.classifiers == 16


def test_grid_query_takes_the_whole_grid(spark, monkeypatch):
    """Nothing narrows the penalties, kept features, components, folds or iterations of the study."""
    from recall_queries import model_queries

    seen, whole = {}, {n: p.default for n, p in inspect.signature(search.logistic_grid).parameters.items()}
    monkeypatch.setattr(model_queries, "split_rows", lambda spark, sf: spark.createDataFrame([("train",)], "split STRING"))
    monkeypatch.setattr(search, "logistic_grid", lambda dataset, **axes: seen.update(axes) or dataset)
    model_queries.m7(spark, "unused")
    asked = whole | seen
    assert asked["c_values"] == tuple(np.logspace(0, 4, 16)) and asked["keeps"] == tuple(range(8, 17)) and asked["components"] is None
    assert asked["folds"] == 5 and asked["max_iter"] == 10_000 and asked["l1"]
    assert asked["reductions"] == ("None", "PCA") and asked["selections"] == (True, False)


def test_grid_without_rows(graded):
    df, spec = graded
    assert search.logistic_grid(df.limit(0), (1.0,), (2,), 2, spec=spec).isEmpty()
    assert search.logistic_grid(df.filter("label = 1"), (1.0,), (2,), 2, spec=spec).isEmpty()


def test_prepare_logistic_has_no_nulls(rows):
    ready, one_hot, scaler, inputs = models.prepare_logistic(rows, models.LogisticSettings())
    assert isinstance(scaler, prep.Scaler) and set(one_hot.outputs) <= set(inputs)
    assert ready.dropna(subset=inputs).count() == rows.count()
