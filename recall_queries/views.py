"""The reference tables (vocabulary, tries, word lists, ...) derived from the driver's parquet tables.

Every view keeps all rows of its base table. Each has a Spark form and a SQL form for the oracle;
the two are written apart, so a wrong view shows up as a mismatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.operators import history

LEARNER = ["learner_id"]
DECK = 13  # words per learner
STEP = 11  # neighbouring learners share DECK - STEP words


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as a vocabulary of 7 columns."""
    key, name, kind = F.col("p_partkey"), F.col("p_name"), F.lower("p_type")
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(p_name, 2)"))
    thing = F.substring_index(name, " ", -1)
    rest = key % 4
    return table(spark, sf, "part").select(
        key.alias("id_vocab"),
        F.when(rest == 0, F.concat(F.lit("der "), capital))
        .when(rest == 1, F.concat(F.lit("die "), capital))
        .otherwise(name)
        .alias("german"),
        F.when(rest == 0, F.concat(F.lit("the "), kind))
        .when(rest == 1, F.concat(F.lit("the "), kind, F.lit(" "), thing))
        .when(rest == 2, F.concat(F.lit("to "), thing))
        .otherwise(F.concat(F.lit("stone "), kind))
        .alias("english"),
        (F.col("p_size") % 7 - 3).cast("long").alias("score_german_english"),
        (F.col("p_size") % 5 - 2).cast("long").alias("score_english_german"),
        (key % 3 == 0).alias("try_session_german_english"),
        (key % 5 == 0).alias("try_session_english_german"),
    )


VOCAB_SQL = """fx_vocab AS (
  SELECT p_partkey AS id_vocab,
         CASE p_partkey % 4 WHEN 0 THEN concat('der ', upper(substr(p_name,1,1)), substr(p_name,2))
                            WHEN 1 THEN concat('die ', upper(substr(p_name,1,1)), substr(p_name,2))
                            ELSE p_name END AS german,
         CASE p_partkey % 4 WHEN 0 THEN concat('the ', lower(p_type))
                            WHEN 1 THEN concat('the ', lower(p_type), ' ', split_part(p_name,' ',2))
                            WHEN 2 THEN concat('to ', split_part(p_name,' ',2))
                            ELSE concat('stone ', lower(p_type)) END AS english,
         CAST(p_size % 7 - 3 AS BIGINT) AS score_german_english,
         CAST(p_size % 5 - 2 AS BIGINT) AS score_english_german,
         p_partkey % 3 = 0 AS try_session_german_english,
         p_partkey % 5 = 0 AS try_session_english_german
  FROM part)"""


def tries(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """All events as tries: each learner repeats a deck of words in both directions.

    The guess is right when ``value >= 30``, else one of four distortions (lower case, a prefix, nothing,
    another word of the dictionary). A lower-cased word that was lower case anyway stays right.
    ``events`` may be a stream of the same table.
    """
    event = F.col("event_id")
    words = vocab(spark, sf).select("id_vocab", "german", "english")
    asked = F.when(F.shiftright(event, 2) % 2 == 0, "german").otherwise("english")
    source = table(spark, sf, "events") if events is None else events
    log = source.select(
        event.alias("id_historical_data"),
        F.col("user_id").alias("learner_id"),
        (F.col("user_id") * STEP + event % DECK).alias("id_vocab"),
        asked.alias("language_asked"),
        (event % 4).alias("_knock"),
        F.col("value").alias("_value"),
        F.col("ts").alias("datetime"),
    )
    # The optimizer compares the word side with the broadcast limit; beyond it AQE splits hot words.
    joined = log.join(words, "id_vocab")
    expected = F.when(F.col("language_asked") == "german", F.col("german")).otherwise(F.col("english"))
    noun = F.col("id_vocab") % 4 < 2
    other = F.when(
        F.col("language_asked") == "german",
        F.when(noun, F.lower(F.expr("substring(german, 5)"))).otherwise(F.col("german")),
    ).otherwise(F.concat(F.lit("stone "), F.get(F.split("english", " "), F.lit(1))))
    knock = F.col("_knock")
    guess = (
        F.when(F.col("_value") >= 30, F.col("_expected"))
        .when(knock == 0, F.lower("_expected"))
        .when(knock == 1, F.concat(F.lit("word "), F.col("_expected")))
        .when(knock == 2, F.lit(""))
        .otherwise(F.col("_other"))
    )
    answered = joined.withColumns({"_expected": expected, "_other": other}).withColumn("guess", guess)
    right = F.col("guess") == F.col("_expected")
    return answered.select(
        "id_historical_data",
        "learner_id",
        "id_vocab",
        F.col("german").alias("german_word"),
        F.col("english").alias("english_word"),
        "language_asked",
        right.cast("double").alias("result"),
        "guess",
        F.floor(F.col("_value") / 10).cast("double").alias("question_time"),
        F.when(
            ~right & (F.col("id_historical_data") % 5 != 0), F.concat_ws(" ", "german", "english", "german")
        ).alias("write_it_again"),
        F.when(~right, knock % 2 == 1).alias("is_it_another_word"),
        F.when(
            ~right & (knock % 2 == 1),
            F.when(F.col("id_historical_data") % 8 == 1, F.lit(0)).otherwise(F.col("id_vocab") + 1),
        ).alias("confused_word"),
        "datetime",
        F.to_date("datetime").alias("day"),
    )


TRIES_SQL = (
    VOCAB_SQL
    + """, fx_tries AS (
  SELECT r.event_id AS id_historical_data, r.learner_id, r.id_vocab,
         r.german AS german_word, r.english AS english_word, r.language_asked,
         CASE WHEN r.guess = r.expected THEN 1.0E0 ELSE 0.0E0 END AS result,
         r.guess,
         CAST(floor(r.value / 10) AS DOUBLE) AS question_time,
         CASE WHEN r.guess = r.expected OR r.event_id % 5 = 0 THEN NULL
              ELSE concat(r.german, ' ', r.english, ' ', r.german) END AS write_it_again,
         CASE WHEN r.guess = r.expected THEN NULL ELSE r.knock % 2 = 1 END AS is_it_another_word,
         CASE WHEN r.guess <> r.expected AND r.knock % 2 = 1
              THEN CASE WHEN r.event_id % 8 = 1 THEN 0 ELSE r.id_vocab + 1 END END AS confused_word,
         r.ts AS datetime, CAST(r.ts AS DATE) AS day
  FROM (SELECT q.*, CASE WHEN q.value >= 30 THEN q.expected
                         WHEN q.knock = 0 THEN lower(q.expected)
                         WHEN q.knock = 1 THEN concat('word ', q.expected)
                         WHEN q.knock = 2 THEN ''
                         WHEN q.language_asked = 'english' THEN concat('stone ', split_part(q.english, ' ', 2))
                         WHEN q.id_vocab % 4 < 2 THEN lower(substr(q.german, 5))
                         ELSE q.german END AS guess
        FROM (SELECT e.event_id, e.user_id AS learner_id, e.ts, e.value,
                     v.id_vocab, v.german, v.english, e.event_id % 4 AS knock,
                     CASE WHEN (e.event_id // 4) % 2 = 0 THEN 'german' ELSE 'english' END AS language_asked,
                     CASE WHEN (e.event_id // 4) % 2 = 0 THEN v.german ELSE v.english END AS expected
              FROM events e JOIN fx_vocab v ON v.id_vocab = e.user_id * 11 + e.event_id % 13) q) r)"""
)


def session_tries(spark: SparkSession, sf: str, partition_by: list[str] | None = None) -> DataFrame:
    """Tries with session and scores, per learner or (``[]``) as the history of a single learner."""
    return marked_session_tries(spark, sf, partition_by)[0]


def marked_session_tries(
    spark: SparkSession, sf: str, partition_by: list[str] | None = None
) -> tuple[DataFrame, int]:
    """As :func:`session_tries`, with the hot-group marks for further operators."""
    keys = LEARNER if partition_by is None else partition_by
    marked, hot_rows = history.mark_hot_groups(tries(spark, sf), keys)
    placed = history.sessionize(marked, keys, position=True, hot_rows=hot_rows)
    scored = history.running_scores(placed, keys, hot_rows)
    return scored, hot_rows


def _session_sql(keys: str) -> str:
    over = f"PARTITION BY {keys} " if keys else ""
    word = f"{keys}, id_vocab" if keys else "id_vocab"
    return f""", fx_gap AS (
  SELECT t.*, coalesce(datetime - lag(datetime) OVER ({over}ORDER BY id_historical_data)
                       > INTERVAL '12' HOUR, FALSE) AS opens
  FROM fx_tries t), fx_scored AS (
  SELECT g.* EXCLUDE (opens),
         CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER ({over}ORDER BY id_historical_data
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS id_session,
         coalesce(sum(2 * result - 1) OVER (PARTITION BY {word}, language_asked ORDER BY id_historical_data
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0) AS score_before,
         coalesce(sum(2 * result - 1) OVER (PARTITION BY {word} ORDER BY id_historical_data
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0) AS score_any
  FROM fx_gap g), fx_session_tries AS (
  SELECT s.* EXCLUDE (score_any), score_any - score_before AS score_before_other_language
  FROM fx_scored s)"""


SESSION_TRIES_SQL = TRIES_SQL + _session_sql("learner_id")
SINGLE_SESSION_TRIES_SQL = TRIES_SQL + _session_sql("")
