"""Streams give what batches give."""

from pyspark.sql import functions as F

from recall_queries import stream_queries, views, vocab_queries
from recall_engine.operators import review
from recall_engine.streaming import review_stream


def rows(df):
    return sorted(map(str, df.collect()))


def test_enriched_stream_is_the_batch(spark, sf_dir):
    words, everything = views.vocab(spark, sf_dir), vocab_queries.all_words(spark, sf_dir)
    columns = ["id_historical_data", "is_it_correct", "is_it_another_word", "confused_word"]
    stream = review_stream.enrich(stream_queries.try_stream(spark, sf_dir), words, everything).select(columns)
    batch = review_stream.enrich(views.tries(spark, sf_dir), words, everything).select(columns)
    assert rows(review_stream.run_to_table(stream, "enriched")) == rows(batch)


def test_micro_batches_update_the_vocabulary_once(spark, sf_dir, tmp_path):
    """Several batches, one of them replayed, equal one batch update."""
    log = views.tries(spark, sf_dir).withColumn("n", F.col("id_historical_data") % 3)
    source = tmp_path / "in"
    words = review.start_session(views.vocab(spark, sf_dir))
    folder = str(tmp_path / "vocab")
    for n in range(3):
        log.filter(F.col("n") == n).coalesce(1).write.mode("append").parquet(str(source))
        kept = review_stream.VocabLog(words, folder, every=2)  # as after a restart
        stream = spark.readStream.schema(log.schema).parquet(str(source))
        kept.run(stream, str(tmp_path / "progress")).awaitTermination()
    before = {p.name for p in (tmp_path / "vocab").rglob("*.parquet")}
    for n in range(3):  # all batches again, as after a failure
        kept.update(log.filter(F.col("n") == n), n)
    assert len(before) > 0 and not (tmp_path / "vocab" / "version=0").exists()
    assert rows(kept.latest()) == rows(review.update_vocab(words, log).select(words.columns))


def test_a_try_counts_for_its_learner(spark, sf_dir, tmp_path):
    log, words = views.tries(spark, sf_dir), vocab_queries.learner_words(spark, sf_dir)
    kept = review_stream.VocabLog(words, str(tmp_path / "vocab"), views.LEARNER)
    for n in range(2):
        kept.update(log.filter(F.col("id_historical_data") % 2 == n), n)
    assert rows(kept.latest()) == rows(review.update_vocab(words, log, views.LEARNER))


def test_sessions_of_a_log_with_one_large_learner(spark, sf_dir):
    """Nine tenths of the tries are one learner's; they are counted in many tasks, and few rows reach its window."""
    log = views.tries(spark, sf_dir).withColumn("learner_id", F.when(F.col("id_historical_data") % 10 > 0, -1).otherwise(F.col("learner_id")))
    log = log.repartition(8)
    done = review_stream.log_sessions(log, views.LEARNER)
    assert rows(done) == rows(review_stream.session_progress(log, views.LEARNER).select(done.columns))
    plan = done._jdf.queryExecution().executedPlan().toString()
    exchange = plan.rindex("Exchange hashpartitioning")  # the first one to run
    assert "partial_count" in plan[exchange:] and "Sort [" not in plan[exchange:] and "MergingSessions" not in plan
    everyone = review_stream.log_sessions(log.drop("learner_id"))
    assert rows(everyone) == rows(review_stream.session_progress(log.withColumn("one", F.lit(1)), ["one"]).drop("one"))


def test_closed_sessions_of_the_stream_are_batch_sessions(spark, sf_dir):
    log = views.tries(spark, sf_dir)
    batch = review_stream.session_progress(review_stream.with_event_time(log), views.LEARNER)
    stream = review_stream.session_progress(
        review_stream.with_event_time(stream_queries.try_stream(spark, sf_dir)), views.LEARNER
    )
    closed = review_stream.run_to_table(stream, "sessions")
    latest = log.agg(F.max("datetime").cast("timestamp")).first()[0]
    watermark = F.lit(latest).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    assert closed.count() > 0
    assert rows(closed) == rows(batch.filter(F.col("end") <= watermark))


def test_gap_of_exactly_twelve_hours_is_one_session(make_tries):
    from conftest import day

    df = make_tries([{"datetime": day(1, 6)}, {"datetime": day(1, 18)}, {"datetime": day(2, 6, 1)}])
    got = sorted(r.tries for r in review_stream.session_progress(df, ["learner_id"]).collect())
    assert got == [1, 2]


def test_batches_of_learners_read_written_tries(spark, sf_dir, monkeypatch):
    """The dictionary is joined once for all batches, not once for each."""
    read, update = [], review_stream.VocabLog.update
    monkeypatch.setattr(review_stream.VocabLog, "update", lambda log, tries, batch: (read.append(tries.inputFiles()), update(log, tries, batch))[1])
    words = stream_queries.r2_stream_per_learner(spark, sf_dir)
    assert len(read) == 6 and all(read)
    assert not [f for found in [*read, words.inputFiles()] for f in found if f.endswith(("part.parquet", "events.parquet"))]
    tried = views.tries(spark, sf_dir)
    again = review.update_vocab(vocab_queries.learner_words(spark, sf_dir), tried, ["learner_id"]).select(words.columns)
    assert rows(words) == rows(again)
