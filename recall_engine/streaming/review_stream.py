"""The review loop as streams of tries: checking, scoring, sessions and progress."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from recall_engine.operators import review
from recall_engine.sources.versions import FoldedLog
from recall_engine.staging import new_path

SESSION_GAP = "12 hours"
LATENESS = "1 hour"


def enrich(tries: DataFrame, vocab: DataFrame, all_vocab: DataFrame) -> DataFrame:
    """Correctness, "is it another word" and the confused word of each try, for batches and streams.

    The dictionary sides are static with one row per word, so a stream joins them without state.
    """
    return review.resolve_guesses(review.check_answer(tries), vocab, all_vocab)


def session_key(gap: str = SESSION_GAP, time: str = "datetime") -> Column:
    """Session window. Tries exactly the gap apart share a session, as in the batch rule."""
    return F.session_window(time, gap)


def with_event_time(tries: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Watermarked tries; watermarks need a TIMESTAMP."""
    return tries.withColumn("datetime", F.col("datetime").cast("timestamp")).withWatermark("datetime", lateness)


def session_progress(tries: DataFrame, partition_by: Sequence[str], gap: str = SESSION_GAP) -> DataFrame:
    """Tries and known words per learner and session. As a stream in append mode: closed sessions only.

    Start and end are aggregates, not fields of the window: the optimizer moves a filter on a grouping
    key below the aggregation, where the windows are not merged yet, and would split sessions.
    """
    time = F.col("datetime")
    return (
        tries.groupBy(*partition_by, session_key(gap).alias("session"))
        .agg(
            F.min(time).alias("start"),
            (F.max(time) + F.expr(f"INTERVAL '{gap}'")).alias("end"),
            F.count(F.lit(1)).alias("tries"),
            F.count_if(F.col("result") == 1).alias("known_words"),
        )
        .drop("session")
    )


def log_sessions(tries: DataFrame, partition_by: Sequence[str] = (), gap: str = SESSION_GAP) -> DataFrame:
    """The rows of :func:`session_progress` over a whole log, whatever share of it one learner has.

    Tries inside one tumbling window as wide as the gap belong together, so partial sessions are a plain aggregation by learner
    and window, combined before its shuffle. They are joined at their edges: a session goes on where the next partial one
    begins no more than the gap after the last try. That window sees one row per learner and gap of time, not tries.
    """
    keys, time = list(partition_by), F.col("datetime")
    parts = tries.groupBy(*keys, F.window(time, gap).alias("_window")).agg(
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.count(F.lit(1)).alias("_tries"),
        F.count_if(F.col("result") == 1).alias("_known"),
    )
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_first")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(ordered) > F.expr(f"INTERVAL '{gap}'"), F.lit(False))
    numbered = parts.withColumn("_opens", opens.cast("long"))
    session = F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        numbered.withColumn("_session", session)
        .groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("start"),
            (F.max("_last") + F.expr(f"INTERVAL '{gap}'")).alias("end"),
            F.sum("_tries").alias("tries"),
            F.sum("_known").alias("known_words"),
        )
        .drop("_session")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that is available and append it to a parquet table, exactly once."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _sum_changes(changes: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in changes.columns if c.startswith("_change_")]
    return changes.groupBy(*partition_by, "id_vocab").agg(*sums)


class VocabLog:
    """A vocabulary that micro-batches of tries update: each writes its score changes, keyed by learner and word.

    The vocabulary itself is never rewritten. Changes are folded at intervals; reading adds them up and joins them
    to the words. A batch that runs again after a failure counts no try twice. A restarted stream opens the same folder.
    """

    def __init__(self, vocab: DataFrame, folder: str, partition_by: Sequence[str] = (), every: int = 16):
        self.vocab, self.partition_by = vocab, list(partition_by)
        keys = [vocab.schema[k] for k in (*self.partition_by, "id_vocab")]
        changes = [StructField(f"_change_{pair}", LongType()) for pair in ("german_english", "english_german")]
        merge = partial(_sum_changes, partition_by=self.partition_by)
        self._log = FoldedLog(vocab.sparkSession, folder, StructType(keys + changes), merge, every)

    def update(self, tries: DataFrame, batch: int) -> None:
        self._log.append(review.score_changes(review.check_answer(tries), self.partition_by), batch)

    def latest(self) -> DataFrame:
        """The words with all changes so far."""
        return review.apply_changes(self.vocab, self._log.read(), self.partition_by)

    def run(self, tries: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            tries.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Drain a stream into a new parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    query = append_to(stream, path, f"{path}-progress")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
