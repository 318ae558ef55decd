"""Sessions, running features and the quirks that decide results."""

import datetime

import pytest
from conftest import day
from pyspark.sql import functions as F

from recall_engine.functions import times
from recall_engine.operators import history
from recall_engine.operators import ordered_scan as scan

ID = "id_historical_data"


def column(df, name):
    return [r[0] for r in df.orderBy(ID).select(name).collect()]


def test_session_ends_after_more_than_twelve_hours(make_tries):
    start = day(4)
    exact = start + datetime.timedelta(hours=12)
    later = exact + datetime.timedelta(hours=12, microseconds=1)
    df = make_tries([{"datetime": t} for t in (start, exact, later, later)])
    for keys in ([], ["learner_id"]):
        done = history.sessionize(df.drop("id_session"), keys, position=True)
        assert column(done, "id_session") == [0, 0, 1, 1]
        assert column(done, "nb_words_session") == [1, 2, 1, 2]  # the current try counts


def test_days_since_success_in_both_semantics(make_tries):
    df = make_tries([{"datetime": day(d), "result": r} for d, r in ((1, 1.0), (3, 0.0), (8, 1.0), (9, 1.0), (15, 0.0))])
    name = "days_since_last_success_same_language"
    rich = history.same_try_features(df)
    assert column(history.word_history(rich), name) == [None, None, None, 1, None]
    assert column(history.word_history(rich, semantics="documented"), name) == [None, 2, 7, 1, 6]


def test_days_since_first_is_the_value_at_the_previous_try(make_tries):
    df = history.same_try_features(make_tries([{"datetime": day(d)} for d in (1, 3, 8)]))
    name = "days_since_first_occur_same_language"
    assert column(history.word_history(df), name) == [None, 0, 2]
    assert column(history.word_history(df, semantics="documented"), name) == [None, 2, 7]


def test_previous_try_per_direction_and_any(make_tries):
    df = make_tries(
        [
            {"language_asked": "german", "result": 0.0, "guess": "die Hund", "write_it_again": "der Hund der Hund"},
            {"language_asked": "english", "result": 1.0, "guess": "the dog"},
            {"language_asked": "german", "datetime": day(6), "is_it_another_word": True, "confused_word": 0, "result": 0.0},
            {"language_asked": "german", "datetime": day(9)},
        ]
    )
    done = history.try_features(df)
    assert column(done, "previous_language_asked") == [None, "german", "english", "german"]
    assert column(done, "previous_result") == [None, None, 0.0, 0.0]
    assert column(done, "previous_correct_article") == [None, None, False, True]
    assert column(done, "previous_write_it_again_german") == [None, None, 2.0, None]
    assert column(done, "previous_write_it_again_not_null") == [None, None, True, False]
    assert column(done, "previous_confused_with_another_word") == [None, None, False, True]
    assert column(done, "previous_confused_with_an_unknown_word") == [None, None, None, True]
    assert column(done, "days_since_last_occurrence_same_language") == [None, None, 2, 3]
    assert not [c for c in done.columns if c.startswith("_")]


def test_confusion_without_a_word_is_false_and_without_confusion_null(make_tries):
    df = make_tries([{"is_it_another_word": x, "confused_word": w} for x, w in ((True, None), (True, 7), (False, 0), (None, None))])
    own = history.same_try_features(df)
    assert column(own, "_confused_with_another_word") == [True, True, False, False]
    assert column(own, "_confused_with_an_unknown_word") == [False, False, None, None]


def test_rows_without_key_vanish_and_half_scores_stay(make_tries):
    df = make_tries([{"id_vocab": None}, {"language_asked": None}, {"score_before": 3.0}])
    done = history.try_features(df)
    assert column(done, ID) == [2]
    assert column(done, "past_successes_same_language") == [1.5]  # an inconsistent score gives halves
    assert column(done, "past_fails_same_language") == [-1.5]


def test_iso_calendar(spark):
    df = spark.createDataFrame([("2021-01-01 23:59:59.999999",), ("2021-01-04 00:00:00.000001",)], "s STRING")
    t = times.parse_time(F.col("s"))
    got = df.select(times.iso_week(t), times.iso_weekday(t), times.hour_of_day(t)).collect()
    assert [tuple(r) for r in got] == [(53, 5, 23), (1, 1, 0)]


def test_trial_hours_drop_whole_days(spark):
    df = spark.sql("SELECT timestamp'2021-01-01 00:00:00' a, timestamp'2021-01-02 06:00:00.9' b")
    assert df.select(times.trial_hours(F.col("a"), F.col("b"))).first()[0] == 6.0


# --- oversized groups -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to one word of one learner."""
    hot = F.col("id") % 3 == 0
    return (
        spark.range(600)
        .withColumn("learner_id", F.when(hot, 0).otherwise(F.col("id") % 7))
        .withColumn("id_vocab", F.when(hot, 0).otherwise(F.col("id") % 5))
        .withColumn("language_asked", F.when(F.hash("id") % 2 == 0, "german").otherwise("english"))
        .withColumn("value", F.when(F.hash("id") % 4 != 1, (F.hash("id") % 50).cast("double")))
        .withColumnRenamed("id", ID)
    )


def features():
    return {
        "n": scan.rows_before(),
        "before": scan.sum_before(F.col("value")),
        "through": scan.sum_through(F.col("value")),
        "last": scan.previous(F.col("value")),
        "asked": scan.previous(F.col("language_asked")),
        "known": scan.last_before(F.col("value")),
        "least": scan.group_min(F.col("value")),
    }


@pytest.mark.parametrize("hot_rows, chunk_rows", [(50, 7), (1, 1), (100, 1000)])
@pytest.mark.parametrize("finer", [[], ["language_asked"]])
def test_split_groups_give_the_same_rows(skewed, hot_rows, chunk_rows, finer):
    keys = ["learner_id", "id_vocab"]
    plain = scan.ordered_scan(skewed, [*keys, *finer], ID, features())
    marked, chunk = scan.split_hot_groups(skewed, keys, ID, "_chunk", hot_rows, chunk_rows)
    assert chunk == "_chunk"
    split = scan.ordered_scan(marked, [*keys, *finer], ID, features(), chunk).drop(chunk)
    columns = plain.columns
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, split.select(columns).collect()))


def test_whole_table_as_one_group(skewed):
    plain = skewed.withColumn("_all", F.lit(1))
    want = scan.ordered_scan(plain, ["_all"], ID, features()).drop("_all")
    marked, chunk = scan.split_hot_groups(skewed, [], ID, "_chunk", chunk_rows=11)
    got = scan.ordered_scan(marked, [], ID, features(), chunk).drop(chunk)
    assert sorted(map(str, want.collect())) == sorted(map(str, got.select(want.columns).collect()))


def test_no_chunk_has_more_rows_than_its_width(skewed):
    marked, chunk = scan.split_hot_groups(skewed, ["learner_id"], ID, "_chunk", 50, 16)
    biggest = marked.filter(F.col(chunk).isNotNull()).groupBy("learner_id", chunk).count().agg(F.max("count")).first()[0]
    assert biggest <= 16


def test_many_hot_groups_take_the_staged_way(skewed, monkeypatch):
    monkeypatch.setattr(scan, "MAX_INLINE_HOT_GROUPS", 2)
    marked, chunk = scan.split_hot_groups(skewed, ["learner_id"], ID, "_chunk", 10, 16)
    got = scan.ordered_scan(marked, ["learner_id"], ID, {"n": scan.rows_before()}, chunk)
    want = scan.ordered_scan(skewed, ["learner_id"], ID, {"n": scan.rows_before()})
    assert column(got, "n") == column(want, "n")


def test_all_features_agree_when_learners_are_oversized(spark, sf_dir):
    from recall_queries import views

    keys = ["learner_id"]
    log = views.session_tries(spark, sf_dir)
    plain = history.try_features(log, keys)
    split = history.try_features(log.drop("nb_words_session"), keys, hot_rows=20)
    assert split.count() == plain.count()
    assert plain.exceptAll(split.select(plain.columns)).isEmpty()


def test_one_shuffle_serves_all_windows(spark, sf_dir):
    """With no oversized learner the plan has one exchange on the learner and no cartesian product."""
    from recall_queries import views

    scored, hot_rows = views.marked_session_tries(spark, sf_dir)
    plan = history.try_features(scored, ["learner_id"], hot_rows=hot_rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Cartesian" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("partitions", ["1", "3", "17"])
def test_result_does_not_depend_on_partitions(spark, skewed, partitions):
    want = column(scan.ordered_scan(skewed, ["learner_id"], ID, {"n": scan.rows_before()}), "n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert column(scan.ordered_scan(skewed, ["learner_id"], ID, {"n": scan.rows_before()}), "n") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 50])
@pytest.mark.parametrize("keys", [[], ["learner_id"]])
def test_sessions_over_chunks(spark, skewed, monkeypatch, chunk_rows, keys):
    """Sessions that begin, end or run through chunk edges, against a plain loop."""
    steps = F.when(F.hash("id_historical_data", "value") % 5 == 0, 50_000).otherwise(20_000)
    order = F.col(ID)
    log = skewed.withColumn("datetime", F.timestamp_seconds(F.lit(1_600_000_000) + order * 9_000 + F.hash(ID) % 30_000 + steps))
    log = log.filter(order < 200)
    monkeypatch.setattr(scan, "CHUNK_ROWS", chunk_rows)
    done = history.sessionize(log, keys, position=True, hot_rows=10)
    state, want = {}, {}
    for r in sorted(log.collect(), key=lambda r: r[ID]):
        key = r.learner_id if keys else None
        last, session, place = state.get(key, (None, 0, 0))
        if last is not None and (r.datetime - last).total_seconds() > 12 * 3600:
            session, place = session + 1, 0
        state[key] = (r.datetime, session, place + 1)
        want[r[ID]] = (session, place + 1)
    assert {r[ID]: (r.id_session, r.nb_words_session) for r in done.collect()} == want
    assert max(s for s, _ in want.values()) > 0
