"""Sessions, windows, history joins and answer text features over the tries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_queries.registry import query
from recall_queries.views import (
    LEARNER,
    SESSION_TRIES_SQL,
    TRIES_SQL,
    marked_session_tries,
    session_tries,
    tries,
)
from recall_engine.functions import text, times
from recall_engine.operators import history, review
from recall_engine.operators import ordered_scan as scan

ID = "id_historical_data"
WORD = [*LEARNER, "id_vocab"]
SAME = "PARTITION BY learner_id, id_vocab, language_asked ORDER BY id_historical_data"
ANY = "PARTITION BY learner_id, id_vocab ORDER BY id_historical_data"

# --- D1 and everything it consists of ---------------------------------------------------------------


def _clean_sql(column: str, articles: str) -> str:
    return f"array_to_string(list_filter(string_split(lower({column}), ' '), lambda t: t NOT IN ({articles})), ' ')"


GERMAN = "'der', 'die', 'das'"
ENGLISH = "'the', 'to'"
OWN_SQL = f""", fx_own AS (
  SELECT t.*,
    CASE WHEN language_asked = 'german' AND split_part(german_word, ' ', 1) IN ({GERMAN})
         THEN split_part(guess, ' ', 1) = split_part(german_word, ' ', 1) END AS correct_article,
    CASE language_asked
      WHEN 'german' THEN levenshtein({_clean_sql('german_word', GERMAN)}, {_clean_sql('guess', GERMAN)})
      WHEN 'english' THEN levenshtein({_clean_sql('english_word', ENGLISH)}, {_clean_sql('guess', ENGLISH)})
    END AS distance,
    CASE WHEN language_asked = 'german'
         THEN regexp_matches(german_word, '[A-Z]') AND lower(german_word) = guess END AS only_uppercase,
    write_it_again IS NOT NULL AS again,
    (length(write_it_again) - length(replace(write_it_again, german_word, ''))) / length(german_word) AS again_german,
    (length(write_it_again) - length(replace(write_it_again, english_word, ''))) / length(english_word) AS again_english,
    coalesce(is_it_another_word, FALSE) AS confused,
    CASE WHEN is_it_another_word THEN coalesce(confused_word = 0, FALSE) END AS confused_unknown,
    CASE WHEN result = 1 THEN day END AS success_day,
    min(day) OVER (PARTITION BY learner_id, id_vocab, language_asked) AS first_same,
    min(day) OVER (PARTITION BY learner_id, id_vocab) AS first_any
  FROM fx_session_tries t)"""

D1_SQL = f"""{OWN_SQL}, fx_features AS (
  SELECT id_historical_data, learner_id, id_vocab, language_asked, id_session, result,
    CAST(row_number() OVER ({SAME}) - 1 AS BIGINT) AS past_occurrences_same_language,
    CAST(row_number() OVER ({ANY}) - 1 AS BIGINT) AS past_occurrences_any_language,
    round((row_number() OVER ({SAME}) - 1 + score_before) / 2, 6) AS past_successes_same_language,
    round((row_number() OVER ({SAME}) - 1 - score_before) / 2, 6) AS past_fails_same_language,
    round((row_number() OVER ({ANY}) - 1 + score_before + score_before_other_language) / 2, 6)
      AS past_successes_any_language,
    round((row_number() OVER ({ANY}) - 1 - score_before - score_before_other_language) / 2, 6)
      AS past_fails_any_language,
    score_before AS previous_score,
    score_before_other_language AS previous_score_other_language,
    CAST(datediff('day', lag(day) OVER ({SAME}), day) AS BIGINT) AS days_since_last_occurrence_same_language,
    CAST(datediff('day', lag(day) OVER ({ANY}), day) AS BIGINT) AS days_since_last_occurrence_any_language,
    CAST(datediff('day', lag(success_day) OVER ({SAME}), success_day) AS BIGINT)
      AS days_since_last_success_same_language,
    CAST(datediff('day', lag(success_day) OVER ({ANY}), success_day) AS BIGINT)
      AS days_since_last_success_any_language,
    CAST(lag(datediff('day', first_same, day)) OVER ({SAME}) AS BIGINT) AS days_since_first_occur_same_language,
    CAST(lag(datediff('day', first_any, day)) OVER ({ANY}) AS BIGINT) AS days_since_first_occur_any_language,
    lag(result) OVER ({SAME}) AS previous_result,
    lag(correct_article) OVER ({SAME}) AS previous_correct_article,
    CAST(lag(distance) OVER ({SAME}) AS BIGINT) AS previous_levenshtein_distance_guess_answer,
    lag(only_uppercase) OVER ({SAME}) AS previous_only_missed_uppercase,
    lag(question_time) OVER ({SAME}) AS previous_question_time,
    lag(again) OVER ({SAME}) AS previous_write_it_again_not_null,
    round(lag(again_german) OVER ({SAME}), 6) AS previous_write_it_again_german,
    round(lag(again_english) OVER ({SAME}), 6) AS previous_write_it_again_english,
    lag(confused) OVER ({SAME}) AS previous_confused_with_another_word,
    lag(confused_unknown) OVER ({SAME}) AS previous_confused_with_an_unknown_word,
    lag(language_asked) OVER ({ANY}) AS previous_language_asked,
    CAST(weekofyear(datetime) AS BIGINT) AS week_number,
    CAST(isodow(datetime) AS BIGINT) AS day_week,
    CAST(hour(datetime) AS BIGINT) AS hour,
    CAST(row_number() OVER (PARTITION BY learner_id, id_session ORDER BY id_historical_data) AS BIGINT)
      AS nb_words_session
  FROM fx_own)"""

D1_COLUMNS = [
    ID,
    "learner_id",
    "id_vocab",
    "language_asked",
    "id_session",
    "result",
    "past_occurrences_same_language",
    "past_occurrences_any_language",
    "past_successes_same_language",
    "past_fails_same_language",
    "past_successes_any_language",
    "past_fails_any_language",
    "previous_score",
    "previous_score_other_language",
    "days_since_last_occurrence_same_language",
    "days_since_last_occurrence_any_language",
    "days_since_last_success_same_language",
    "days_since_last_success_any_language",
    "days_since_first_occur_same_language",
    "days_since_first_occur_any_language",
    "previous_result",
    "previous_correct_article",
    "previous_levenshtein_distance_guess_answer",
    "previous_only_missed_uppercase",
    "previous_question_time",
    "previous_write_it_again_not_null",
    "previous_write_it_again_german",
    "previous_write_it_again_english",
    "previous_confused_with_another_word",
    "previous_confused_with_an_unknown_word",
    "previous_language_asked",
    "week_number",
    "day_week",
    "hour",
    "nb_words_session",
]
FEATURES_SQL = f"{SESSION_TRIES_SQL}{D1_SQL}"


def features(spark, sf):
    scored, hot_rows = marked_session_tries(spark, sf)
    return history.try_features(scored, LEARNER, hot_rows=hot_rows)


@query("d1_try_features", f"WITH {FEATURES_SQL} SELECT * FROM fx_features")
def d1(spark, sf):
    return features(spark, sf).select(*D1_COLUMNS)


# --- sessions ---------------------------------------------------------------------------------------


@query("w1_sessionize", f"WITH {SESSION_TRIES_SQL} SELECT id_historical_data, learner_id, id_session FROM fx_session_tries")
def w1(spark, sf):
    return history.sessionize(tries(spark, sf), LEARNER).select(ID, "learner_id", "id_session")


@query(
    "w1_sessionize_one_learner",
    f"""WITH {TRIES_SQL}, g AS (
      SELECT id_historical_data, coalesce(datetime - lag(datetime) OVER (ORDER BY id_historical_data)
             > INTERVAL '4' MINUTE, FALSE) AS opens FROM fx_tries)
    SELECT id_historical_data, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END)
           OVER (ORDER BY id_historical_data ROWS UNBOUNDED PRECEDING) AS BIGINT) AS id_session FROM g""",
)
def w1_single(spark, sf):
    # The whole log is one group here and runs in chunks with carried state.
    return history.sessionize(tries(spark, sf), gap="INTERVAL '4' MINUTE").select(ID, "id_session")


# --- running counts and recency -----------------------------------------------------------------------


def _words(spark, sf):
    """Tries, split where a word of a learner is oversized."""
    return scan.split_hot_groups(tries(spark, sf), WORD, ID, "_chunk")


@query(
    "w2_past_occurrences_same",
    f"WITH {TRIES_SQL} SELECT id_historical_data, CAST(row_number() OVER ({SAME}) - 1 AS BIGINT) AS n FROM fx_tries",
)
def w2(spark, sf):
    df, chunk = _words(spark, sf)
    return scan.ordered_scan(df, [*WORD, "language_asked"], ID, {"n": scan.rows_before()}, chunk).select(ID, "n")


@query(
    "w3_past_occurrences_any",
    f"WITH {TRIES_SQL} SELECT id_historical_data, CAST(row_number() OVER ({ANY}) - 1 AS BIGINT) AS n FROM fx_tries",
)
def w3(spark, sf):
    df, chunk = _words(spark, sf)
    return scan.ordered_scan(df, WORD, ID, {"n": scan.rows_before()}, chunk).select(ID, "n")


W4 = [
    "past_successes_same_language",
    "past_fails_same_language",
    "past_successes_any_language",
    "past_fails_any_language",
]


@query("w4_successes_fails", f"WITH {FEATURES_SQL} SELECT id_historical_data, {', '.join(W4)} FROM fx_features")
def w4(spark, sf):
    return features(spark, sf).select(ID, *W4)


def _word_history(spark, sf, semantics="reference"):
    return history.word_history(history.same_try_features(tries(spark, sf)), LEARNER, semantics)


def _history_columns(name, columns, semantics="reference", sql=None):
    """Register some columns of the word history as a query."""

    @query(name, sql or f"WITH {FEATURES_SQL} SELECT id_historical_data, {', '.join(columns)} FROM fx_features")
    def run(spark, sf):
        return _word_history(spark, sf, semantics).select(ID, *columns)

    return run


_history_columns(
    "w5_days_since_last_occurrence",
    ["days_since_last_occurrence_same_language", "days_since_last_occurrence_any_language"],
)
_history_columns(
    "w6_days_since_last_success",
    ["days_since_last_success_same_language", "days_since_last_success_any_language"],
)
_history_columns(
    "w6_days_since_last_success_documented",
    ["days_since_last_success_same_language", "days_since_last_success_any_language"],
    "documented",
    f"""WITH {SESSION_TRIES_SQL}{OWN_SQL} SELECT id_historical_data,
      CAST(datediff('day', last_value(success_day IGNORE NULLS) OVER ({SAME}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day) AS BIGINT) AS days_since_last_success_same_language,
      CAST(datediff('day', last_value(success_day IGNORE NULLS) OVER ({ANY}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day) AS BIGINT) AS days_since_last_success_any_language
    FROM fx_own""",
)
_history_columns(
    "w7_days_since_first_occurrence",
    ["days_since_first_occur_same_language", "days_since_first_occur_any_language"],
)


@query("w8_position_in_session", f"WITH {FEATURES_SQL} SELECT id_historical_data, nb_words_session FROM fx_features")
def w8(spark, sf):
    return history.sessionize(tries(spark, sf), LEARNER, position=True).select(ID, "nb_words_session")


J5 = [f"previous_{name}" for name in history.CARRIED_SAME_LANGUAGE] + ["days_since_first_occur_same_language"]
J5_CAST = [c if "levenshtein" not in c else f"CAST({c} AS BIGINT) AS {c}" for c in J5]
_history_columns(
    "j5_previous_try_same_language",
    J5,
    sql=f"WITH {FEATURES_SQL} SELECT id_historical_data, {', '.join(J5_CAST)} FROM fx_features",
)
_history_columns(
    "j6_previous_try_any_language", ["previous_language_asked", "days_since_first_occur_any_language"]
)
_history_columns(
    "w9_previous_try_transfer",
    ["previous_result", "previous_question_time", "previous_language_asked"],
    sql=f"""WITH {TRIES_SQL}, n AS (
      SELECT *, row_number() OVER ({SAME}) AS n_same, row_number() OVER ({ANY}) AS n_any FROM fx_tries)
    SELECT a.id_historical_data, b.result AS previous_result, b.question_time AS previous_question_time,
           c.language_asked AS previous_language_asked
    FROM n a
    LEFT JOIN n b ON a.learner_id = b.learner_id AND a.id_vocab = b.id_vocab
                 AND a.language_asked = b.language_asked AND a.n_same = b.n_same + 1
    LEFT JOIN n c ON a.learner_id = c.learner_id AND a.id_vocab = c.id_vocab AND a.n_any = c.n_any + 1""",
)


@query(
    "j3_count_joined_on_row_id",
    f"""WITH {TRIES_SQL}, c AS (
      SELECT id_historical_data, CAST(count(*) OVER ({SAME} ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS n FROM fx_tries)
    SELECT t.id_historical_data, t.learner_id, c.n FROM fx_tries t JOIN c USING (id_historical_data)""",
)
def j3(spark, sf):
    # The join on the row id is a window column here.
    df, chunk = _words(spark, sf)
    counted = scan.ordered_scan(df, [*WORD, "language_asked"], ID, {"n": scan.rows_before()}, chunk)
    return counted.select(ID, "learner_id", "n")


@query(
    "j4_first_occurrence_day",
    f"""WITH {TRIES_SQL}, s AS (SELECT learner_id, id_vocab, language_asked, min(day) AS d FROM fx_tries GROUP BY ALL),
      a AS (SELECT learner_id, id_vocab, min(day) AS d FROM fx_tries GROUP BY ALL)
    SELECT t.id_historical_data, CAST(datediff('day', s.d, t.day) AS BIGINT) AS since_same,
           CAST(datediff('day', a.d, t.day) AS BIGINT) AS since_any
    FROM fx_tries t LEFT JOIN s USING (learner_id, id_vocab, language_asked)
                    LEFT JOIN a USING (learner_id, id_vocab)""",
)
def j4(spark, sf):
    df, chunk = _words(spark, sf)
    any_day = scan.ordered_scan(df, WORD, ID, {"any": scan.group_min(F.col("day"))}, chunk)
    both = scan.ordered_scan(any_day, [*WORD, "language_asked"], ID, {"same": scan.group_min(F.col("day"))}, chunk)
    return both.select(
        ID, F.date_diff("day", "same").alias("since_same"), F.date_diff("day", "any").alias("since_any")
    )


# --- scalar features of a try -------------------------------------------------------------------------


@query(
    "f1_parse_time",
    f"""WITH {TRIES_SQL} SELECT id_historical_data, strftime(datetime, '%Y-%m-%d %H:%M:%S.%f') AS time_text,
      strftime(day, '%Y-%m-%d') AS day_text FROM fx_tries""",
)
def f1(spark, sf):
    log = tries(spark, sf).select(ID, F.date_format("datetime", times.TRY_TIME).alias("time_text"))
    parsed = times.parse_time(F.col("time_text"))
    return log.select(
        ID, F.date_format(parsed, times.TRY_TIME).alias("time_text"), F.date_format(F.to_date(parsed), "yyyy-MM-dd").alias("day_text")
    )


def _calendar(name, column, sql):
    @query(name, f"WITH {TRIES_SQL} SELECT id_historical_data, CAST({sql} AS BIGINT) AS {column} FROM fx_tries")
    def run(spark, sf):
        return history.calendar(tries(spark, sf)).select(ID, column)


_calendar("f2_iso_week", "week_number", "weekofyear(datetime)")
_calendar("f3_iso_weekday", "day_week", "isodow(datetime)")
_calendar("f4_hour", "hour", "hour(datetime)")


def _own(name, columns, sql):
    """Register features a try has about itself."""

    @query(name, f"WITH {SESSION_TRIES_SQL}{OWN_SQL} SELECT id_historical_data, {sql} FROM fx_own")
    def run(spark, sf):
        own = history.same_try_features(tries(spark, sf))
        return own.select(ID, *[F.col(source).alias(name) for name, source in columns.items()])


_own(
    "f11_answer_distance",
    {"distance": "_levenshtein_distance_guess_answer"},
    "CAST(distance AS BIGINT) AS distance",
)
_own("f13_correct_article", {"correct_article": "_correct_article"}, "correct_article")
_own("f14_only_missed_uppercase", {"only_uppercase": "_only_missed_uppercase"}, "only_uppercase")
_own(
    "f15_write_it_again",
    {
        "again": "_write_it_again_not_null",
        "again_german": "_write_it_again_german",
        "again_english": "_write_it_again_english",
    },
    "again, round(again_german, 6) AS again_german, round(again_english, 6) AS again_english",
)
_own(
    "f16_confusion_flags",
    {"confused": "_confused_with_another_word", "confused_unknown": "_confused_with_an_unknown_word"},
    "confused, confused_unknown",
)


@query(
    "f12_leading_article",
    f"""WITH {TRIES_SQL} SELECT id_historical_data,
      CASE WHEN split_part(german_word, ' ', 1) IN ({GERMAN}) THEN split_part(german_word, ' ', 1) END AS answer_article,
      CASE WHEN split_part(guess, ' ', 1) IN ({GERMAN}) THEN split_part(guess, ' ', 1) END AS guess_article
    FROM fx_tries""",
)
def f12(spark, sf):
    return tries(spark, sf).select(
        ID,
        text.german_article(F.col("german_word")).alias("answer_article"),
        text.german_article(F.col("guess")).alias("guess_article"),
    )


@query(
    "f17_copies_of_the_try",
    f"""WITH {SESSION_TRIES_SQL} SELECT id_historical_data, language_asked AS previous_language_asked,
      result AS previous_result, question_time AS previous_question_time, score_before AS previous_score,
      score_before_other_language AS previous_score_other_language FROM fx_session_tries""",
)
def f17(spark, sf):
    return session_tries(spark, sf).select(
        ID,
        *[F.col(c).alias(f"previous_{c}") for c in ("language_asked", "result", "question_time")],
        F.col("score_before").alias("previous_score"),
        F.col("score_before_other_language").alias("previous_score_other_language"),
    )


@query(
    "f18_check_answer",
    f"""WITH {TRIES_SQL} SELECT id_historical_data,
      guess = CASE language_asked WHEN 'german' THEN german_word ELSE english_word END AS is_it_correct FROM fx_tries""",
)
def f18(spark, sf):
    return review.check_answer(tries(spark, sf)).select(ID, "is_it_correct")


@query(
    "t1_fill_guess",
    f"WITH {TRIES_SQL} SELECT id_historical_data, coalesce(nullif(guess, ''), '') AS guess FROM fx_tries",
)
def t1(spark, sf):
    lost = tries(spark, sf).withColumn("guess", F.nullif("guess", F.lit("")))
    return lost.fillna({"guess": ""}).select(ID, "guess")
