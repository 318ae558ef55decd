"""Next-session frames, splits, folds and encoders."""

import math

import pytest
from pyspark.sql import functions as F

from recall_queries import views
from recall_engine.operators import datasets, prep
from recall_engine.operators import word_state
from recall_engine.schemas import FEATURES
from recall_engine.staging import stage

ID = "id_historical_data"


@pytest.mark.parametrize("semantics", ["reference", "documented"])
@pytest.mark.parametrize("keys", [[], ["learner_id"]])
def test_next_session_equals_the_long_way(spark, sf_dir, semantics, keys):
    log = views.session_tries(spark, sf_dir, keys)
    words = views.vocab(spark, sf_dir)
    if keys:
        words = log.select("learner_id", "id_vocab").distinct().join(words, "id_vocab")
    now = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    future = datasets.future_tries(words, datasets.last_ids(log, keys), now, keys)
    short = datasets.next_session_features(log, future, keys, semantics)
    columns = [*keys, "id_vocab", ID, "id_session", *[c for c in FEATURES.all if c in short.columns]]
    long = datasets.next_session_by_union(log, future, keys, semantics)
    a = datasets.cast_roles(short.select(columns))
    b = datasets.cast_roles(long.select(columns))
    assert a.count() == b.count() == 2 * words.count()
    assert a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("keys", [[], ["learner_id"]])
def test_appended_state_is_the_state_of_the_whole_history(spark, sf_dir, tmp_path, keys):
    """Whatever the order of the parts; a batch again, a fold between and a restart change nothing."""
    log = stage(views.session_tries(spark, sf_dir, keys), "log")
    part = F.pmod(F.xxhash64(ID), F.lit(5))
    for batch in (0, 1, 1, 2, 3, 2, 4):
        word_state.StateLog.of(log, str(tmp_path / "state"), keys, every=2).append(log.filter(part == batch), batch)
    kept = word_state.StateLog.of(log, str(tmp_path / "state"), keys).read()
    whole = word_state.word_state(log, keys)
    assert kept.columns == whole.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))


def test_the_next_session_needs_no_sort_aggregate(spark, sf_dir):
    log = views.session_tries(spark, sf_dir, [])
    now = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    future = datasets.future_tries(views.vocab(spark, sf_dir), datasets.last_ids(log), now)
    plan = datasets.next_session_features(log, future)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("HashAggregate") > 2


def test_future_rows_are_numbered_in_vocabulary_order(spark, sf_dir):
    log = views.session_tries(spark, sf_dir, [])
    last = datasets.last_ids(log).first()
    now = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    rows = datasets.future_tries(views.vocab(spark, sf_dir), datasets.last_ids(log), now).filter("language_asked = 'german'")
    got = rows.orderBy("id_vocab").select(ID, "nb_words_session", "id_session").collect()
    assert [r[0] for r in got] == list(range(last.max_id_historical_data + 1, last.max_id_historical_data + 1 + len(got)))
    assert [r[1] for r in got] == list(range(1, len(got) + 1))
    assert {r[2] for r in got} == {last.max_id_session + 1}


@pytest.mark.parametrize("n", [1, 2, 5, 10, 11, 30])
def test_split_shares(spark, n):
    df = spark.range(n * 3).select((F.col("id") % n).alias("id_session"))
    got = {r.id_session: r.split for r in datasets.split_by_session(df).distinct().collect()}
    test = math.ceil(0.10 * n)
    valid = math.ceil(0.18 * (n - test))
    want = ["train"] * (n - test - valid) + ["valid"] * valid + ["test"] * test
    assert [got[i] for i in range(n)] == want


def test_folds(spark):
    df = spark.range(10).select(F.col("id").alias("id_session"))
    rows = datasets.expanding_folds(df, 2, 3).collect()
    roles = {(f, r): sorted(x.id_session for x in rows if x.fold == f and x.role == r) for f in (0, 1) for r in ("train", "valid")}
    assert roles[0, "train"] == list(range(7)) and roles[0, "valid"] == [7, 8, 9]
    assert roles[1, "train"] == list(range(4)) and roles[1, "valid"] == [4, 5, 6]


def test_cast_keeps_three_valued_booleans(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None)], "n INT, previous_result DOUBLE")
    assert [r[1] for r in datasets.cast_roles(df).orderBy("n").collect()] == [True, False, None]


def test_feature_catalogue():
    assert len(FEATURES.numerical) == 22 and len(FEATURES.diff_time) == 6
    assert len(FEATURES.boolean) == 8 and len(FEATURES.categorical) == 2
    assert FEATURES.outside(["hour", "result", "id_vocab", "day"]) == ["id_vocab", "day"]


def test_one_hot_at_inference(spark):
    train = spark.createDataFrame([("a", True), ("b", None)], "c STRING, f BOOLEAN")
    fitted = prep.OneHot.fit(train, ["c", "f"])
    assert fitted.outputs == ["c__a", "c__b", "c__nan", "f__True", "f__nan"]
    unseen = spark.createDataFrame([("z", False), (None, None)], "c STRING, f BOOLEAN")
    got = fitted.transform(unseen).select(fitted.outputs).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, 0), (0, 0, 1, 0, 1)]


def test_one_hot_of_values_that_are_no_plain_column_names(spark):
    train = spark.createDataFrame([("x.y",), ("a`b",), ("c",)], "c STRING")
    fitted = prep.OneHot.fit(train, ["c"])
    coded = fitted.transform(train)
    assert prep.Scaler.fit(coded, fitted.outputs).transform(coded).count() == 3
    assert [sum(r) for r in coded.select(fitted.outputs).collect()] == [1, 1, 1]


def test_one_hot_refuses_identifiers(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_DUMMIES", 3)
    with pytest.raises(ValueError):
        prep.OneHot.fit(spark.range(9).select(F.col("id").cast("string").alias("c")), ["c"])


@pytest.mark.parametrize("inline", [1000, 1])
def test_label_index_orders_by_first_appearance(spark, inline):
    train = spark.createDataFrame([(0, None), (1, "b"), (2, "a"), (3, "b")], "o INT, c STRING")
    index = prep.LabelIndex.fit(train, ["c"], "o", inline)
    assert (index.inline is None) == (inline == 1)
    kept, rejected = index.transform(spark.createDataFrame([("a",), ("new",), (None,), ("b",)], "c STRING"))
    assert sorted(r.c for r in kept.collect()) == [0.0, 1.0, 2.0]
    assert [r.c for r in rejected.collect()] == ["new"]
    back = index.inverse(kept)
    assert sorted(str(r.c) for r in back.collect()) == ["None", "a", "b"]


def test_scaler_uses_the_population_and_leaves_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x DOUBLE, y DOUBLE")
    got = prep.Scaler.fit(df, ["x", "y"]).transform(df).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_sparse_one_hot_is_the_dense_form(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("b", True), ("a", False), (None, None), ("b", True)], "c string, f boolean")
    later = spark.createDataFrame([(1, "a", None), (2, "zz", True), (3, None, False), (4, "b", True), (5, "b", True)], "id long, c string, f boolean")
    dense = {r.id: r for r in prep.OneHot.fit(train, ["c", "f"]).transform(later).collect()}
    sparse = prep.SparseOneHot.fit(train, ["c", "f"]).transform(later)
    assert sparse.columns == ["id", "c__vector", "f__vector"]
    for r in sparse.select("id", vector_to_array("c__vector").alias("c"), vector_to_array("f__vector").alias("f")).collect():
        assert r.c + r.f == list(dense[r.id])[1:]


def test_sparse_one_hot_of_many_categories(spark):
    n = 100_000
    rows = spark.range(n + 1).select("id", F.when(F.col("id") < n, F.format_string("c%06d", "id")).alias("c"))
    fitted = prep.SparseOneHot.fit(rows, ["c"])
    assert fitted.sizes == {"c": n}
    found = fitted.transform(rows.filter("id % 25000 = 0").unionByName(spark.createDataFrame([(-1, "new")], "id long, c string")))
    got = {r.id: (r.c__vector.size, r.c__vector.indices.tolist()) for r in found.collect()}
    assert got == {-1: (n + 1, []), 0: (n + 1, [0]), 25_000: (n + 1, [25_000]), 50_000: (n + 1, [50_000]), 75_000: (n + 1, [75_000]), n: (n + 1, [n])}


def test_ranks_share_and_no_window_is_unpartitioned(spark):
    from recall_engine.operators import reports

    trials = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, None), (5, 0.1)], "id long, score double")
    ranked = reports.rank_trials(trials, "score")
    assert {r.id: r.rank_test_score for r in ranked.collect()} == {1: 2, 2: 1, 3: 2, 4: 5, 5: 4}
    sessions = spark.range(30).select((F.col("id") % 7).alias("id_session"))
    done = datasets.session_ranks(sessions)
    assert sorted((r.id_session, r.session_rank, r.nb_sessions) for r in done.collect()) == [(i, i, 7) for i in range(7)]
    assert "SinglePartition" not in datasets.split_by_session(sessions)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_scaler_takes_the_moments_of_many_columns_in_two_aggregates(spark):
    names = [f"x{i}" for i in range(60)]
    df = spark.range(50).select(*[F.when(F.col("id") % 7 != i % 7, (F.col("id") * (i + 1) % 11).cast("double")).alias(n) for i, n in enumerate(names)], F.lit(None).cast("double").alias("never"))
    widths = []
    with pytest.MonkeyPatch.context() as patch:
        true = type(df).agg
        patch.setattr(type(df), "agg", lambda self, *parts: widths.append(len(parts)) or true(self, *parts))
        fitted = prep.Scaler.fit(df, [*names, "never"])
    assert not widths  # no aggregate a column side by side
    row = df.agg(*[f(n).alias(f"{n}{t}") for n in names for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    assert fitted.moments["never"] == (None, 1.0)
    for n in names:
        assert fitted.moments[n] == pytest.approx((row[f"{n}m"], row[f"{n}s"] or 1.0))
