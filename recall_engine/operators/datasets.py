"""Training sets, next-session frames, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.operators import history
from recall_engine.operators.global_order import dense_id
from recall_engine.operators.word_state import next_session_from_state, word_state
from recall_engine.schemas import FEATURES, LANGUAGES, FeatureSpec


def merge_features(tries: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tries with their word features.

    An equi-join left to the optimizer: a small vocabulary is broadcast after a size check, otherwise
    AQE splits a hot word. Sorting by time is left to whoever writes the result.
    """
    shared = [c for c in vocab.columns if c in tries.columns and c != "id_vocab"]
    return tries.join(vocab.drop(*shared), "id_vocab")


def cast_roles(dataset: DataFrame, spec: FeatureSpec = FEATURES) -> DataFrame:
    """Give every column the type of its role; nulls stay null, booleans stay three-valued."""
    kinds = {spec.target: "double"}
    kinds.update({c: "double" for c in spec.numerical + spec.diff_time})
    kinds.update({c: "boolean" for c in spec.boolean})
    kinds.update({c: "string" for c in spec.categorical})
    present = set(dataset.columns)
    return dataset.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in present})


def training_set(tries_with_features: DataFrame, vocab_with_features: DataFrame) -> DataFrame:
    return cast_roles(merge_features(tries_with_features, vocab_with_features))


# --- the next session -------------------------------------------------------------------------------


def last_ids(tries: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Largest session id and row id, per learner or over all."""
    return tries.groupBy(*partition_by).agg(
        F.max("id_session").alias("max_id_session"), F.max(history.ORDER).alias("max_id_historical_data")
    )


def future_tries(
    vocab: DataFrame,
    last: DataFrame,
    now: Column,
    partition_by: Sequence[str] = (),
    languages: Sequence[str] = LANGUAGES,
    order: str = "id_vocab",
) -> DataFrame:
    """One future row per word and direction, in one new session.

    Rows are numbered in vocabulary order, the same numbers in both directions. ``now`` is a parameter,
    so a run can be repeated.
    """
    if partition_by:
        placed = history.scan.split_hot_groups(vocab, list(partition_by), order, "_chunk")
        numbered = history.scan.ordered_scan(
            placed[0], list(partition_by), order, {"_place": history.scan.rows_before()}, placed[1]
        ).join(last, list(partition_by))
    else:
        row = last.select(F.struct("*")).scalar()
        numbered = dense_id(vocab, [order], "_place").withColumns({c: row[c] for c in last.columns})
    asked = numbered.withColumn("language_asked", F.explode(F.array(*[F.lit(x) for x in languages])))
    german = F.col("language_asked") == "german"
    to_german, to_english = F.col("score_english_german"), F.col("score_german_english")
    return asked.select(
        *partition_by,
        "id_vocab",
        F.col("german").alias("german_word"),
        F.col("english").alias("english_word"),
        "language_asked",
        F.when(german, to_german).otherwise(to_english).cast("double").alias("score_before"),
        F.when(german, to_english).otherwise(to_german).cast("double").alias("score_before_other_language"),
        F.lit("").alias("guess"),
        F.lit(0.0).alias("question_time"),
        F.lit("").alias("write_it_again"),
        F.lit(0).cast("long").alias("confused_word"),
        F.lit(False).alias("is_it_another_word"),
        now.alias("datetime"),
        F.to_date(now).alias("day"),
        (F.col("max_id_session") + 1).alias("id_session"),
        (F.col("max_id_historical_data") + 1 + F.col("_place")).cast("long").alias(history.ORDER),
        (F.col("_place") + 1).alias("nb_words_session"),
    )


def next_session_by_union(
    tries: DataFrame, future: DataFrame, partition_by: Sequence[str] = (), semantics: str = "reference"
) -> DataFrame:
    """Features of future rows the long way: append them to the history and keep only them.

    Each direction is a scenario of its own with a copy of the history. Kept as the definition;
    :func:`next_session_features` gives the same rows from one aggregation.
    """
    past = tries.drop("nb_words_session").withColumns(
        {"scenario": F.explode(F.array(*[F.lit(x) for x in LANGUAGES])), "is_future": F.lit(False)}
    )
    coming = future.drop("nb_words_session").withColumns({"scenario": F.col("language_asked"), "is_future": F.lit(True)})
    both = past.unionByName(coming, allowMissingColumns=True)
    done = history.try_features(both, [*partition_by, "scenario"], semantics)
    return done.filter("is_future").drop("scenario", "is_future")


def next_session_features(
    tries: DataFrame, future: DataFrame, partition_by: Sequence[str] = (), semantics: str = "reference"
) -> DataFrame:
    """Features of future rows from one aggregate per word and direction: counts, first day and last try.

    The history is read once and pre-aggregated before its only shuffle, so a hot word is no problem. Where the state is
    kept up to date (``word_state.StateLog``), ``next_session_from_state`` needs no history at all.
    """
    return next_session_from_state(word_state(tries, partition_by), future, partition_by, semantics)


def probabilities_by_word(scored: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row per word, one probability column per direction."""
    wide = (
        scored.groupBy(*partition_by, "id_vocab")
        .pivot("language_asked", ["english", "german"])
        .agg(F.first("y_proba"))
    )
    return wide.withColumnsRenamed({"english": "english_proba", "german": "german_proba"})


# --- splits -----------------------------------------------------------------------------------------


def session_ranks(dataset: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Distinct sessions with their 0-based rank and the number of sessions.

    Sessions are at least a gap apart, so a learner has a few hundred a year: the ranking window is small. Without a
    learner the sessions of all are numbered by ranges.
    """
    sessions = dataset.select(*partition_by, "id_session").distinct()
    if not partition_by:
        ranked = dense_id(sessions, ["id_session"], "session_rank")
        return ranked.withColumn("nb_sessions", ranked.agg(F.count(F.lit(1))).scalar())
    whole = Window.partitionBy(*partition_by)
    return sessions.withColumns(
        {
            "session_rank": F.row_number().over(whole.orderBy("id_session")) - 1,
            "nb_sessions": F.count(F.lit(1)).over(whole),
        }
    )


def _attach(dataset: DataFrame, small: DataFrame, partition_by: Sequence[str], columns: list[str]) -> DataFrame:
    """Add per-learner values, or the values of a one-row table when there is one learner."""
    if partition_by:
        return dataset.join(small, list(partition_by))
    row = small.select(F.struct(*columns)).scalar()
    return dataset.withColumns({c: row[c] for c in columns})


def split_by_session(
    dataset: DataFrame, partition_by: Sequence[str] = (), test: float = 0.10, valid: float = 0.18
) -> DataFrame:
    """Add ``split``: the last tenth of the sessions is ``test``, the last 18 % of the rest ``valid``.

    Two session ids per learner decide, so no list of sessions travels anywhere.
    """
    n = F.col("nb_sessions")
    held_out = F.ceil(F.lit(float(test)) * n)
    tuning = F.ceil(F.lit(float(valid)) * (n - held_out))
    bounds = (
        session_ranks(dataset, partition_by)
        .groupBy(*partition_by)
        .agg(
            F.min(F.when(F.col("session_rank") >= n - held_out, F.col("id_session"))).alias("_test_from"),
            F.min(F.when(F.col("session_rank") >= n - held_out - tuning, F.col("id_session"))).alias("_valid_from"),
        )
    )
    marked = _attach(dataset, bounds, partition_by, ["_test_from", "_valid_from"])
    session = F.col("id_session")
    return marked.withColumn(
        "split",
        F.when(session >= F.col("_test_from"), "test").when(session >= F.col("_valid_from"), "valid").otherwise("train"),
    ).drop("_test_from", "_valid_from")


def expanding_folds(
    dataset: DataFrame, nb_folds: int, nb_sessions_valid: int, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Add ``fold`` and ``role``: fold i validates on the i-th last block of sessions and trains before it.

    A row appears once per fold that uses it; later sessions than the block are in neither role.
    """
    counts = dataset.groupBy(*partition_by).agg((F.max("id_session") + 1).alias("_sessions"))
    sized = _attach(dataset, counts, partition_by, ["_sessions"])
    copies = sized.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(nb_folds - 1))))
    upper = F.col("_sessions") - F.col("fold") * nb_sessions_valid
    lower = upper - nb_sessions_valid
    session = F.col("id_session")
    role = F.when(session < lower, "train").when(session < upper, "valid")
    return copies.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_sessions")
