"""What the next session needs of the history, one row per learner, word and direction.

The state of some tries is an aggregation of fixed-width values (hash aggregation, combined before its shuffle), and states merge:
the state of a history equals the merged states of its parts, in whatever order they come. Kept as a log of deltas
(:class:`recall_engine.sources.versions.FoldedLog`), new tries update it and the next session reads no history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recall_engine.operators import history
from recall_engine.sources.versions import FoldedLog

CARRIED = history.CARRIED_SAME_LANGUAGE


def _keys(partition_by: Sequence[str]) -> list[str]:
    return [*partition_by, "id_vocab", "language_asked"]


def word_state(tries: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Counts, first and last day, and the last row with its carried values; ``tries`` may be a part of the history."""
    past = history.same_try_features(history.with_known_keys(tries))
    row, day = F.col(history.ORDER), F.col("day")
    success = F.when(F.col("result") == 1, row)
    return past.groupBy(*_keys(partition_by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(day).alias("first_day"),
        F.max(row).alias("last_row"),
        F.max_by(day, row).alias("last_day"),
        F.max(success).alias("success_row"),
        F.max_by(day, success).alias("success_day"),
        *[F.max_by(history.carried_value(name), row).alias(name) for name in CARRIED],
    )


def merge_states(states: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row a key from the rows of several states."""
    return states.groupBy(*_keys(partition_by)).agg(
        F.sum("n").alias("n"),
        F.min("first_day").alias("first_day"),
        F.max("last_row").alias("last_row"),
        F.max_by("last_day", "last_row").alias("last_day"),
        F.max("success_row").alias("success_row"),
        F.max_by("success_day", "success_row").alias("success_day"),
        *[F.max_by(name, "last_row").alias(name) for name in CARRIED],
    )


class StateLog:
    """The state of a growing history: each batch of appended tries writes its own small delta."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, partition_by: Sequence[str] = (), every: int = 16):
        self.partition_by = list(partition_by)
        self._log = FoldedLog(spark, folder, schema, partial(merge_states, partition_by=self.partition_by), every)

    @classmethod
    def of(cls, tries: DataFrame, folder: str, partition_by: Sequence[str] = (), every: int = 16) -> StateLog:
        """Opens or begins the log for tries like these; none is read."""
        return cls(tries.sparkSession, folder, word_state(tries, partition_by).schema, partition_by, every)

    def append(self, tries: DataFrame, batch: int) -> None:
        """Take in new tries. The same batch again changes nothing."""
        self._log.append(word_state(tries, self.partition_by), batch)

    def read(self) -> DataFrame:
        return self._log.read()


def next_session_from_state(
    state: DataFrame, future: DataFrame, partition_by: Sequence[str] = (), semantics: str = "reference"
) -> DataFrame:
    """Features of the future rows from the state alone. ``future`` comes from ``datasets.future_tries``."""
    faithful = history._check_semantics(semantics)
    keys = _keys(partition_by)
    words = state.groupBy(*keys[:-1]).agg(
        F.sum("n").alias("_n_any"),
        F.min("first_day").alias("_first_any"),
        F.max_by("last_day", "last_row").alias("_last_any"),
        F.max_by("success_day", "success_row").alias("_success_any"),
        F.max_by(F.col("language_asked") == "german", "last_row").alias("_german"),
    )
    own = {"n": "_n_same", "first_day": "_first_same", "last_day": "_last_same", "success_day": "_success_same"}
    mine = state.select(*keys, *[F.col(c).alias(n) for c, n in own.items()], *[F.col(n).alias(f"previous_{n}") for n in CARRIED])
    joined = future.join(mine, keys, "left").join(words, keys[:-1], "left")
    today = F.col("day")
    columns: dict[str, Column] = {}
    for scope, short in (("same_language", "same"), ("any_language", "any")):
        last_day, first_day = F.col(f"_last_{short}"), F.least(F.col(f"_first_{short}"), today)
        columns[f"past_occurrences_{scope}"] = F.coalesce(F.col(f"_n_{short}"), F.lit(0))
        columns[f"days_since_last_occurrence_{scope}"] = F.date_diff(today, last_day)
        success = F.lit(None).cast("int") if faithful else F.date_diff(today, F.col(f"_success_{short}"))
        columns[f"days_since_last_success_{scope}"] = success
        since = F.date_diff(last_day if faithful else today, first_day)
        columns[f"days_since_first_occur_{scope}"] = F.when(last_day.isNotNull(), since)
    columns["previous_language_asked"] = F.when(F.col("_german"), "german").when(~F.col("_german"), "english")
    done = history.calendar(history.successes_and_fails(joined.withColumns(columns)))
    return done.drop(*[c for c in done.columns if c.startswith("_")])
