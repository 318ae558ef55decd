"""Score update golden, confusion lookups, report, selection and dictionary growth."""

import math

import pytest
from pyspark.sql import functions as F

from recall_engine.functions.hashing import gumbel
from recall_engine.operators import review, selection, vocabulary
from recall_engine.schemas import VOCAB_DDL

# 14 words with their scores (german to english, english to german) before the session.
BEFORE = [
    (1, "rennen", "to sprint", 0, 3),
    (2, "richtig", "correct", 0, -1),
    (3, "September", "September", 2, 1),
    (4, "sprechen", "to speak", 1, 0),
    (5, "stimmen", "to vote", 1, 0),
    (6, "verheiratet", "married", 2, -1),
    (7, "wirklich", "really", 1, 2),
    (8, "die Aprikose", "the apricot", -1, -2),
    (9, "das Jahr", "the year", -1, 2),
    (10, "viel", "a lot", -1, 2),
    (11, "die Ärztin", "the female doctor", 1, -2),
    (12, "zusammen", "together", 2, 1),
    (13, "wilkommen", "welcome", 2, 1),
    (14, "der Pokal", "the cup", 1, -2),
]
# The 14 tries (word, asked, guess) and the scores after them.
TRIES = [
    (3, "german", "September"),
    (6, "german", "scj"),
    (10, "english", "a lot"),
    (11, "german", "Arztin"),
    (8, "german", "die Aprikose"),
    (5, "german", "aslöjcpwj"),
    (4, "german", "vkKEV+"),
    (9, "german", "vm"),
    (7, "english", ""),
    (1, "english", ""),
    (14, "german", ""),
    (13, "english", ""),
    (2, "german", ""),
    (12, "german", ""),
]
AFTER = {
    1: (-1, 3),
    2: (0, -2),
    3: (2, 2),
    4: (1, -1),
    5: (1, -1),
    6: (2, -2),
    7: (0, 2),
    8: (-1, -1),
    9: (-1, 1),
    10: (0, 2),
    11: (1, -3),
    12: (2, 0),
    13: (1, 1),
    14: (1, -3),
}


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame([(*r, True, True) for r in BEFORE], VOCAB_DDL)


@pytest.fixture
def tries(spark):
    words = {r[0]: r[1:3] for r in BEFORE}
    rows = [(i, *words[i], asked, guess) for i, asked, guess in TRIES]
    return spark.createDataFrame(rows, "id_vocab LONG, german_word STRING, english_word STRING, language_asked STRING, guess STRING")


def test_update_vocab_golden(vocab, tries):
    done = review.update_vocab(review.start_session(vocab), tries)
    got = {r.id_vocab: r for r in done.collect()}
    assert {i: (r.score_german_english, r.score_english_german) for i, r in got.items()} == AFTER
    asked = {i: a for i, a, _ in TRIES}
    assert all(r.try_session_english_german == (asked[i] == "german") for i, r in got.items())
    assert all(r.try_session_german_english == (asked[i] == "english") for i, r in got.items())
    assert done.dtypes == vocab.dtypes


def test_confusions(spark, vocab):
    rows = [
        (1, "rennen", "to sprint", "english", "to sprint"),
        (1, "rennen", "to sprint", "english", "married"),
        (1, "rennen", "to sprint", "english", "to jump"),
        (1, "rennen", "to sprint", "english", "verheiratet"),
        (1, "rennen", "to sprint", "german", "September"),
    ]
    log = spark.createDataFrame(
        [(n, *r) for n, r in enumerate(rows)],
        "n INT, id_vocab LONG, german_word STRING, english_word STRING, language_asked STRING, guess STRING",
    )
    words = vocab.select("german", "english").unionByName(spark.createDataFrame([("springen", "to jump")] * 2, "german STRING, english STRING"))
    flagged = review.flag_other_words(review.check_answer(log), words)
    done = review.resolve_confusion(flagged, vocab).orderBy("n").collect()
    assert [r.is_it_another_word for r in done] == [None, True, True, False, True]
    assert [r.confused_word for r in done] == [None, 6, 0, None, 3]


def test_report(spark):
    df = spark.createDataFrame([(1, 0.4, 0.9), (2, 0.5, 0.5), (3, 0.9, 0.1)], "id_vocab INT, english_proba DOUBLE, german_proba DOUBLE")
    assert tuple(review.knowledge_report(df).first()) == (3, 2, 1, True)


def with_probabilities(vocab):
    return vocab.withColumns({"german_proba": F.lit(0.5), "english_proba": F.col("id_vocab") / 20})


def test_softmax_sums_to_one(vocab):
    words = selection.softmax_weights(with_probabilities(vocab), "english_proba", {"w": 3.0})
    assert words.agg(F.sum("w")).first()[0] == pytest.approx(1.0)
    weights = [math.exp(3 * (1 - i / 20)) for i in range(1, 15)]
    assert words.filter("id_vocab = 1").first().w == pytest.approx(weights[0] / sum(weights))


def test_draw_follows_the_weights(spark):
    """First picks over many seeds have the softmax frequencies."""
    words = spark.createDataFrame([(1, 0.1), (2, 0.9)], "id_vocab LONG, p DOUBLE")
    seeds = words.crossJoin(spark.range(4000).withColumnRenamed("id", "s"))
    drawn = seeds.withColumn("d", 3 * (1 - F.col("p")) + gumbel(1, F.col("id_vocab"), F.col("s")))
    first = drawn.groupBy("s").agg(F.max_by("id_vocab", "d").alias("w")).filter("w = 1").count() / 4000
    want = math.exp(2.7) / (math.exp(2.7) + math.exp(0.3))
    assert first == pytest.approx(want, abs=0.02)


def test_session_plan_has_no_tried_or_repeated_word(vocab):
    words = with_probabilities(vocab.withColumns({"try_session_german_english": F.col("id_vocab") < 4, "try_session_english_german": F.lit(False)}))
    plan = selection.plan_session(words, seed=5, tries=8).collect()
    ids = [r.id_vocab for r in plan]
    assert len(ids) == len(set(ids)) == 8 and min(ids) >= 4
    assert [r.slot for r in sorted(plan, key=lambda r: -r.draw)] == list(range(1, 9))
    again = selection.plan_session(words, seed=5, tries=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_a_learner_is_not_touched_by_another(spark):
    words = spark.createDataFrame(
        [(1, 7, 0, 0, False, False), (2, 7, 0, 0, False, False)],
        "learner_id LONG, id_vocab LONG, score_german_english LONG, score_english_german LONG, "
        "try_session_german_english BOOLEAN, try_session_english_german BOOLEAN",
    )
    tries = spark.createDataFrame([(1, 7, "german", "Hund", "Hund", "dog")], "learner_id LONG, id_vocab LONG, language_asked STRING, guess STRING, german_word STRING, english_word STRING")
    done = {r.learner_id: (r.score_english_german, r.try_session_english_german) for r in review.update_vocab(words, tries, ["learner_id"]).collect()}
    assert done == {1: (1, True), 2: (0, False)}
    known = spark.createDataFrame([(1, 7, 0.2, 0.9), (2, 7, 0.8, 0.9)], "learner_id LONG, id_vocab LONG, english_proba DOUBLE, german_proba DOUBLE")
    joined = review.with_probabilities(words, known, ["learner_id"])
    assert joined.count() == 2
    report = {r.learner_id: r.words_left for r in review.knowledge_report(joined, partition_by=["learner_id"]).collect()}
    assert report == {1: 1, 2: 0}


def test_session_plan_of_a_learner_with_most_words(spark):
    words = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("learner_id"), F.col("id").alias("id_vocab"),
        F.lit(False).alias("try_session_german_english"), F.lit(False).alias("try_session_english_german"),
        (F.col("id") % 100 / 100.0).alias("english_proba"), F.lit(0.5).alias("german_proba"),
    )
    plan = selection.plan_session(words, 5, 20, partition_by=["learner_id"])
    one = plan.filter("learner_id = 1").orderBy("slot").collect()
    assert [r.slot for r in one] == list(range(1, 21))
    alone = selection.with_direction(words.filter("learner_id = 1"), 5, ["learner_id"]).withColumn(
        "p", F.when(F.col("language_asked") == "german", F.col("german_proba")).otherwise(F.col("english_proba"))
    )
    drawn = alone.withColumn("d", 3 * (1 - F.col("p")) + gumbel(5, F.col("learner_id"), F.col("id_vocab")))
    assert [r.id_vocab for r in one] == [r.id_vocab for r in drawn.orderBy(F.col("d").desc()).limit(20).collect()]
    assert plan.filter("learner_id <> 1").groupBy("learner_id").count().filter("count <> 1").isEmpty()


def test_add_words_in_priority_order(spark, vocab):
    first = spark.createDataFrame([("neu", "new"), ("viel", "plenty"), ("alt", "old"), ("alt", "old")], "German STRING, English STRING")
    second = spark.createDataFrame([("neu", "fresh"), ("jung", "young")], "German STRING, English STRING")
    done = vocabulary.add_words(vocab, [first, second])
    added = done.filter("id_vocab > 14").orderBy("id_vocab").collect()
    # repeats inside a list stay; "viel" and the second "neu" are known
    assert sorted(r.german for r in added) == ["alt", "alt", "jung", "neu"]
    assert [r.id_vocab for r in added] == [15, 16, 17, 18] and added[-1].german == "jung"
    assert {(r.score_german_english, r.try_session_german_english) for r in added} == {(0, False)}


def test_first_words_of_an_empty_vocabulary(spark, vocab):
    one = spark.createDataFrame([("neu", "new")], "German STRING, English STRING")
    assert [r.id_vocab for r in vocabulary.add_words(vocab.limit(0), [one]).collect()] == [1]
