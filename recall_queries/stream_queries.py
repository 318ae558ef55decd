"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_queries import vocab_queries
from recall_queries.registry import query
from recall_queries.views import LEARNER, SINGLE_SESSION_TRIES_SQL, TRIES_SQL, VOCAB_SQL, session_tries, table, tries, vocab
from recall_engine.operators import reports, review
from recall_engine.sources import files
from recall_engine.staging import new_path, stage
from recall_engine.streaming import review_stream

ID = "id_historical_data"
LOG_COLUMNS = (
    "id_vocab german_word english_word score_before score_before_other_language language_asked result guess "
    "question_time write_it_again confused_word is_it_another_word datetime"
).split()

# --- sources and sinks ------------------------------------------------------------------------------


def _log_files(spark, sf):
    """The tries as a CSV log of 13 columns in time order."""
    log = session_tries(spark, sf, [])
    path = new_path(spark, "log")
    files.write_csv(log.orderBy(ID).select(*LOG_COLUMNS), path)
    return path


@query(
    "s1_read_tries",
    f"""WITH {SINGLE_SESSION_TRIES_SQL} SELECT id_historical_data, id_vocab, german_word, english_word, language_asked, result,
      guess, question_time, write_it_again, CAST(confused_word AS BIGINT) AS confused_word, is_it_another_word,
      round(score_before, 6) AS score_before, round(score_before_other_language, 6) AS score_before_other_language, id_session, strftime(day, '%Y-%m-%d') AS day, CAST(epoch_us(datetime) AS BIGINT) AS micros FROM fx_session_tries""",
)
def s1(spark, sf):
    read = files.read_tries(spark, _log_files(spark, sf))
    return read.select(
        ID,
        *[c for c in LOG_COLUMNS if c != "datetime"],
        "id_session",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        # wall-clock time of the log, whatever the session zone is
        F.unix_micros(F.from_utc_timestamp("datetime", F.current_timezone())).alias("micros"),
    )


@query("s2_read_vocab", f"WITH {VOCAB_SQL} SELECT id_vocab, german, english FROM fx_vocab")
def s2(spark, sf):
    path = new_path(spark, "vocab")
    files.write_csv(vocab(spark, sf), path)
    return files.read_vocab(spark, path)


@query("s2_read_vocab_all_columns", f"WITH {VOCAB_SQL} SELECT * FROM fx_vocab")
def s2_all(spark, sf):
    path = new_path(spark, "vocab")
    files.write_csv(vocab(spark, sf), path)
    return files.read_vocab(spark, path, "all")


@query("s3_read_all_vocab", f"WITH {VOCAB_SQL}, {vocab_queries.ALL_WORDS_SQL} SELECT english FROM fx_all")
def s3(spark, sf):
    path = new_path(spark, "all_vocab")
    files.write_csv(vocab_queries.all_words(spark, sf), path)
    return files.read_all_vocab(spark, path, ["english"])


@query(
    "s4_read_word_lists",
    f"""WITH {vocab_queries.LISTS_SQL} SELECT "German", "English", CAST(difficulty_category AS BIGINT) AS difficulty_category,
      CASE WHEN difficulty_category < 4 OR id_vocab % 2 = 0 THEN CAST(difficulty_category AS BIGINT) END AS "Score" FROM fx_lists""",
)
def s4(spark, sf):
    folder = new_path(spark, "lists")
    points = F.col("difficulty_category")
    lists = vocab_queries.word_lists(spark, sf)
    # Two lists come without the score columns, as the course lists do; each shares its points with a list that has them.
    plain = F.col("id_vocab") % 2 == 1
    name = (
        F.when(plain & (points == 4), "a1_2").when(plain & (points == 5), "a1_1").when(points < 0, F.concat(F.lit("Minus"), -points, F.lit("points")))
        .otherwise(F.concat(points.cast("string"), F.lit("points")))
    )
    named = stage(lists.withColumn("name", name), "lists")
    for list_name in files.LIST_POINTS:
        rows = named.filter(F.col("name") == list_name)
        columns = ["German", "English"]
        if not list_name.startswith("a"):
            rows = rows.withColumns(
                {"Score": points, **{c: F.lit(False) for c in ("SucceedSession", "Succeed", "TrySession")}, "Retry": F.lit("01/01/2022")}
            )
            columns += ["Score", "SucceedSession", "Succeed", "TrySession", "Retry"]
        files.write_csv(rows.select(*columns), f"{folder}/{list_name}.csv")
    return files.read_word_lists(spark, folder).select("German", "English", "difficulty_category", "Score")


@query(
    "s5_read_log_lines",
    """SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS line, 'trial ' || event_id || ' ' || event_type AS value FROM events""",
)
def s5(spark, sf):
    path = new_path(spark, "trials")
    line = F.concat(F.lit("  trial "), F.col("event_id").cast("string"), F.lit(" "), "event_type", F.lit(" \n   \n"))
    log = table(spark, sf, "events").orderBy("event_id").select(line.alias("value"))
    log.write.text(path)
    return files.read_log_lines(spark, path)


@query(
    "s6_csv_sink",
    f"""WITH {VOCAB_SQL}, {vocab_queries.PREDICTIONS_SQL} SELECT id_vocab, round(english_proba, 6) AS english_proba,
      round(german_proba, 6) AS german_proba FROM fx_predictions""",
)
def s6(spark, sf):
    path = new_path(spark, "predictions")
    files.write_csv(vocab_queries.predictions(spark, sf), path)
    return files.read_predictions(spark, path)


@query("s7_append_tries", f"WITH {TRIES_SQL} SELECT id_historical_data, guess, result FROM fx_tries")
def s7(spark, sf):
    path = new_path(spark, "history")
    log = tries(spark, sf).select(ID, "guess", "result", "day")
    middle = F.lit("2024-01-15").cast("date")
    files.append_tries(log.filter(F.col("day") < middle), path)
    files.append_tries(log.filter(F.col("day") >= middle), path)
    return spark.read.schema(log.schema).parquet(path).drop("day")


@query("s8_stage_dataset", f"WITH {TRIES_SQL} SELECT id_historical_data, language_asked, is_it_another_word FROM fx_tries")
def s8(spark, sf):
    return stage(tries(spark, sf), "tries").select(ID, "language_asked", "is_it_another_word")


@query(
    "s10_publish_predictions",
    f"""WITH {VOCAB_SQL}, {vocab_queries.PREDICTIONS_SQL} SELECT id_vocab, round(english_proba, 6) AS english_proba,
      round(german_proba, 6) AS german_proba FROM fx_predictions""",
)
def s10(spark, sf):
    published = new_path(spark, "published")
    predictions = vocab_queries.predictions(spark, sf)
    files.publish(predictions.withColumn("english_proba", F.lit(0.5)), published)  # an older version
    files.publish(predictions, published)
    return files.read_published(spark, published)


# --- streams ----------------------------------------------------------------------------------------


def try_stream(spark, sf):
    """The tries as a file stream."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return tries(spark, sf, stream)


@query(
    "r1_enrich_tries_stream",
    f"""WITH {vocab_queries.CONFUSION_SQL}, g AS (SELECT german AS w, min(id_vocab) AS id FROM fx_vocab GROUP BY 1),
      e AS (SELECT english AS w, min(id_vocab) AS id FROM fx_vocab GROUP BY 1)
    SELECT f.id_historical_data, is_it_correct, f.is_it_another_word, CASE WHEN f.is_it_another_word THEN
      coalesce(CASE f.language_asked WHEN 'german' THEN g.id ELSE e.id END, 0) END AS confused_word
    FROM fx_flagged f JOIN fx_checked c USING (id_historical_data) LEFT JOIN g ON g.w = f.guess LEFT JOIN e ON e.w = f.guess""",
)
def r1(spark, sf):
    enriched = review_stream.enrich(try_stream(spark, sf), vocab(spark, sf), vocab_queries.all_words(spark, sf))
    columns = [ID, "is_it_correct", "is_it_another_word", "confused_word"]
    return review_stream.run_to_table(enriched.select(*columns), "enriched")


@query(
    "r2_update_vocab_stream",
    f"""WITH {TRIES_SQL}, c AS (
      SELECT id_vocab, sum(CASE WHEN language_asked = 'english' THEN 2 * result - 1 END) AS de_en,
             sum(CASE WHEN language_asked = 'german' THEN 2 * result - 1 END) AS en_de FROM fx_tries GROUP BY id_vocab)
    SELECT id_vocab, CAST(score_german_english + coalesce(de_en, 0) AS BIGINT) AS score_german_english,
      CAST(score_english_german + coalesce(en_de, 0) AS BIGINT) AS score_english_german,
      de_en IS NOT NULL AS try_session_german_english, en_de IS NOT NULL AS try_session_english_german
    FROM fx_vocab LEFT JOIN c USING (id_vocab)""",
)
def r2_stream(spark, sf):
    folder = new_path(spark, "vocab")
    log = review_stream.VocabLog(review.start_session(vocab(spark, sf)), folder)
    log.run(try_stream(spark, sf), f"{folder}-progress").awaitTermination()
    return log.latest().drop("german", "english")


@query("r2_update_vocab_stream_per_learner", vocab_queries.R2_LEARNER_SQL)
def r2_stream_per_learner(spark, sf):
    """Five micro-batches of one log, one of them twice, with folds between; a try counts for its learner alone."""
    # Written once: every batch would join, and broadcast, the dictionary again.
    tried = stage(tries(spark, sf).select(*LEARNER, ID, "id_vocab", "german_word", "english_word", "language_asked", "guess"), "tries")
    words = vocab_queries.learner_words(spark, sf, tried)
    log = review_stream.VocabLog(words, new_path(spark, "vocab"), LEARNER, every=2)
    for batch in (0, 1, 2, 2, 3, 4):
        log.update(tried.filter(F.col(ID) % 5 == batch), batch)
    columns = ["score_german_english", "score_english_german", "try_session_german_english", "try_session_english_german"]
    return log.latest().select(*LEARNER, "id_vocab", *columns)


PROGRESS_SQL = f"""{TRIES_SQL}, g AS (
  SELECT *, coalesce(datetime - lag(datetime) OVER (PARTITION BY learner_id ORDER BY datetime) > INTERVAL '12' HOUR, FALSE) AS opens
  FROM fx_tries), s AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY learner_id ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS n
  FROM g), fx_progress AS (
  SELECT learner_id, min(datetime) AS start, max(datetime) + INTERVAL '12' HOUR AS "end", count(*) AS tries,
         count(*) FILTER (result = 1) AS known_words FROM s GROUP BY learner_id, n)"""


@query("r3_session_windows", f'WITH {PROGRESS_SQL} SELECT learner_id, start, "end", tries FROM fx_progress')
def r3(spark, sf):
    return review_stream.log_sessions(tries(spark, sf), LEARNER).drop("known_words")


@query("r4_session_progress", f"WITH {PROGRESS_SQL} SELECT learner_id, start, tries, known_words FROM fx_progress")
def r4(spark, sf):
    return review_stream.log_sessions(tries(spark, sf), LEARNER).drop("end")


@query(
    "r3_r4_session_stream",
    f"""WITH {PROGRESS_SQL} SELECT learner_id, start, tries, known_words FROM fx_progress
    WHERE "end" <= (SELECT date_trunc('milliseconds', max(datetime)) - INTERVAL '1' HOUR FROM fx_tries)""",
)
def r3_stream(spark, sf):
    # Sessions that the watermark has closed; those still open at the end of the log are held back.
    stream = review_stream.session_progress(review_stream.with_event_time(try_stream(spark, sf)), LEARNER)
    closed = review_stream.run_to_table(stream, "sessions")
    return closed.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end")


@query(
    "f21_f22_log_file",
    """SELECT event_id + 1 AS n_trial, event_id % 97 / 1000.0E0 AS learning_rate, event_id % 40 AS max_depth,
      value AS "MAE", event_id % 60 AS time_seconds FROM events""",
)
def log_file(spark, sf):
    """A trial log as a text file: written, read in order, four lines put together."""
    event = F.col("event_id")
    text = F.concat_ws(
        "\n",
        F.lit("trial"),
        F.concat(F.lit("{'learning_rate': "), (event % 97 / 1000.0).cast("string"), F.lit(", 'max_depth': "), (event % 40).cast("string"), F.lit("}")),
        F.col("value").cast("string"),
        (event % 60).cast("string"),
    )
    path = new_path(spark, "trials")
    table(spark, sf, "events").orderBy("event_id").select(text.alias("value")).write.text(path)
    return reports.four_line_trials(files.read_log_lines(spark, path), "line", ["learning_rate", "max_depth"])
