"""Features of a try from the history before it.

``partition_by`` names the learner column(s); without it the table is the history of one learner.
Every function expects the unique row number ``id_historical_data`` that fixes the order of tries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions import text, times
from recall_engine.operators import ordered_scan as scan

ORDER = "id_historical_data"
SESSION_GAP = "INTERVAL '12' HOUR"
LEARNER_CHUNK = "_learner_chunk"
WORD_CHUNK = "_word_chunk"
NEVER_HOT = -1  # as ``hot_rows``: the caller knows that no group is oversized


def _mark(df: DataFrame, keys: list[str], chunk: str, hot_rows: int | None) -> tuple[DataFrame, str | None]:
    if chunk in df.columns:
        return df, chunk
    if hot_rows == NEVER_HOT and keys:
        return df, None
    return scan.split_hot_groups(df, keys, ORDER, chunk, hot_rows)


def with_known_keys(df: DataFrame) -> DataFrame:
    """Rows without a word or a direction belong to no group and leave the history."""
    return df.filter(F.col("id_vocab").isNotNull() & F.col("language_asked").isNotNull())


def mark_hot_groups(
    df: DataFrame, partition_by: Sequence[str] = (), hot_rows: int | None = None
) -> tuple[DataFrame, int]:
    """Look for oversized learners and words once for a chain of operators.

    Returns the frame, with chunk columns where there are any, and the ``hot_rows`` to pass on.
    """
    keys = list(partition_by)
    marked, learner_chunk = scan.split_hot_groups(df, keys, ORDER, LEARNER_CHUNK, hot_rows)
    if learner_chunk is None:
        return df, NEVER_HOT  # a word of a learner cannot outgrow the learner
    marked, _ = scan.split_hot_groups(marked, [*keys, "id_vocab"], ORDER, WORD_CHUNK, hot_rows)
    return marked, NEVER_HOT


def sessionize(
    df: DataFrame,
    partition_by: Sequence[str] = (),
    gap: str = SESSION_GAP,
    position: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``id_session``: a session ends when the next try is more than ``gap`` later.

    ``position`` also adds ``nb_words_session``, the 1-based place of the try in its session. Sessions are
    runs of the learner's order, so both come from one sort; only oversized learners need a carry.
    """
    keys = list(partition_by)
    df, chunk = _mark(df, keys, LEARNER_CHUNK, hot_rows)
    groups = [*keys, *([chunk] if chunk else [])]
    ordered = Window.partitionBy(*groups).orderBy(ORDER)
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    time = F.col("datetime")
    local = df.withColumns(
        {"_opens": _apart(time, F.lag(time).over(ordered), gap), "_n": F.row_number().over(ordered).cast("long")}
    ).withColumns(
        {
            "_sessions": F.sum("_opens").over(through),
            "_start": F.max(F.when(F.col("_opens") == 1, F.col("_n"))).over(through),
        }
    )
    if chunk:
        local = local.join(_session_carry(local, keys, groups, chunk, gap), groups, "left")
    else:
        local = local.withColumns({"_sessions_before": F.lit(0), "_rows_before": F.lit(0)})
    done = local.withColumn("id_session", F.col("_sessions") + F.coalesce("_sessions_before", F.lit(0)))
    if position:
        place = F.when(F.col("_start").isNotNull(), F.col("_n") - F.col("_start") + 1).otherwise(
            F.col("_n") + F.coalesce("_rows_before", F.lit(0))
        )
        done = done.withColumn("nb_words_session", place)
    return done.drop("_opens", "_n", "_sessions", "_start", "_sessions_before", "_rows_before")


def _apart(later: Column, earlier: Column, gap: str) -> Column:
    """1 when two times are more than the gap apart, 0 when not or when there is no earlier one."""
    return F.coalesce(later - earlier > F.expr(gap), F.lit(False)).cast("int")


def _session_carry(local: DataFrame, keys: list[str], groups: list[str], chunk: str, gap: str) -> DataFrame:
    """Per chunk: sessions opened before its rows, and rows the running session already has."""
    parts = (
        local.filter(F.col(chunk).isNotNull())
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min_by("datetime", ORDER).alias("_first"),
            F.max_by("datetime", ORDER).alias("_last"),
            F.max("_sessions").alias("_opened"),
            F.max("_start").alias("_last_start"),
        )
    )
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk)
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumns(
        {"_broken": _apart(F.col("_first"), F.lag("_last").over(ordered), gap), "_total": F.sum("_rows").over(through)}
    )
    # Rows before the start of the session that is open at the end of a chunk in which one started.
    settled = F.when(
        F.col("_last_start").isNotNull(), F.col("_total") - F.col("_rows") + F.col("_last_start") - 1
    ).when(F.col("_broken") == 1, F.col("_total") - F.col("_rows"))
    open_rows = counted.withColumn(
        "_open", F.col("_total") - F.coalesce(F.last(settled, ignorenulls=True).over(through), F.lit(0))
    )
    unbroken = F.col("_broken") == 0
    return open_rows.select(
        *groups,
        (F.coalesce(F.sum(F.col("_opened") + F.col("_broken")).over(earlier), F.lit(0)) + F.col("_broken")).alias(
            "_sessions_before"
        ),
        F.when(unbroken, F.lag("_open").over(ordered)).alias("_rows_before"),
    )


def session_position(df: DataFrame, partition_by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Add ``nb_words_session``: tries of the session so far, this one included."""
    df, chunk = _mark(df, list(partition_by), LEARNER_CHUNK, hot_rows)
    placed = scan.ordered_scan(
        df, [*partition_by, "id_session"], ORDER, {"nb_words_session": scan.rows_before()}, chunk
    )
    return placed.withColumn("nb_words_session", F.col("nb_words_session") + 1)


def drop_marks(df: DataFrame) -> DataFrame:
    return df.drop(LEARNER_CHUNK, WORD_CHUNK)


def running_scores(df: DataFrame, partition_by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Add ``score_before`` and ``score_before_other_language``: successes minus fails so far."""
    keys = [*partition_by, "id_vocab"]
    df, chunk = _mark(df, keys, WORD_CHUNK, hot_rows)
    point = F.col("result") * 2 - 1
    both = scan.ordered_scan(df, keys, ORDER, {"_score_any": scan.sum_before(point)}, chunk)
    same = scan.ordered_scan(
        both, [*keys, "language_asked"], ORDER, {"score_before": scan.sum_before(point)}, chunk
    )
    return same.withColumn("score_before_other_language", F.col("_score_any") - F.col("score_before")).drop(
        "_score_any"
    )


def same_try_features(df: DataFrame) -> DataFrame:
    """What a try tells about itself; later tries see these values as ``previous_*``."""
    asked = F.col("language_asked")
    again = F.col("write_it_again")
    confused = F.coalesce(F.col("is_it_another_word"), F.lit(False))
    return df.withColumns(
        {
            "_correct_article": text.correct_article(F.col("german_word"), F.col("guess"), asked),
            "_levenshtein_distance_guess_answer": text.answer_distance(
                F.col("german_word"), F.col("english_word"), F.col("guess"), asked
            ),
            "_only_missed_uppercase": text.only_missed_uppercase(F.col("german_word"), F.col("guess"), asked),
            "_write_it_again_not_null": again.isNotNull(),
            "_write_it_again_german": text.count_in(again, F.col("german_word")).cast("double"),
            "_write_it_again_english": text.count_in(again, F.col("english_word")).cast("double"),
            "_confused_with_another_word": confused,
            "_confused_with_an_unknown_word": F.when(
                confused, F.coalesce(F.col("confused_word") == 0, F.lit(False))
            ),
        }
    )


# Values of a try that the next try in the same direction receives as ``previous_<name>``.
CARRIED_SAME_LANGUAGE = (
    "result",
    "correct_article",
    "levenshtein_distance_guess_answer",
    "only_missed_uppercase",
    "question_time",
    "write_it_again_not_null",
    "write_it_again_german",
    "write_it_again_english",
    "confused_with_another_word",
    "confused_with_an_unknown_word",
)


def carried_value(name: str) -> Column:
    return F.col(name if name in ("result", "question_time") else f"_{name}")


def success_day() -> Column:
    return F.when(F.col("result") == 1, F.col("day"))


def word_history(
    df: DataFrame,
    partition_by: Sequence[str] = (),
    semantics: str = "reference",
    hot_rows: int | None = None,
) -> DataFrame:
    """Occurrences, recency and the previous try of the word, per direction and in any direction.

    Both groupings share one shuffle on learner and word. ``semantics="reference"`` keeps two
    published peculiarities: days since the last success exist only when this try and the one just
    before both succeeded (which reveals the current result), and days since the first occurrence is
    the value at the previous try. ``"documented"`` measures both from the current try.
    """
    faithful = _check_semantics(semantics)
    keys = [*partition_by, "id_vocab"]
    df, chunk = _mark(with_known_keys(df), keys, WORD_CHUNK, hot_rows)
    day = F.col("day")
    shared = {
        "_occurrences": scan.rows_before(),
        "_day": scan.previous(day),
        "_first_day": scan.group_min(day),
    }
    if faithful:
        shared["_success_day"] = scan.previous(success_day())
    else:
        shared["_success_day"] = scan.last_before(success_day())

    any_language = {
        **shared,
        "previous_language_asked": scan.previous(F.col("language_asked")),
    }
    seen = scan.ordered_scan(df, keys, ORDER, any_language, chunk)
    seen = _recency(seen, "any_language", faithful)

    same_language = {**shared}
    for name in CARRIED_SAME_LANGUAGE:
        same_language[f"previous_{name}"] = scan.previous(carried_value(name))
    seen = scan.ordered_scan(seen, [*keys, "language_asked"], ORDER, same_language, chunk)
    return _recency(seen, "same_language", faithful)


def _check_semantics(semantics: str) -> bool:
    if semantics not in ("reference", "documented"):
        raise ValueError("semantics is 'reference' or 'documented'")
    return semantics == "reference"


def _recency(df: DataFrame, scope: str, faithful: bool) -> DataFrame:
    """Name the shared running values of one grouping and turn days into differences."""
    since_success = F.date_diff(success_day() if faithful else F.col("day"), F.col("_success_day"))
    since_first = F.date_diff(F.col("_day") if faithful else F.col("day"), F.col("_first_day"))
    return df.withColumns(
        {
            f"past_occurrences_{scope}": F.col("_occurrences"),
            f"days_since_last_occurrence_{scope}": F.date_diff(F.col("day"), F.col("_day")),
            f"days_since_last_success_{scope}": since_success,
            f"days_since_first_occur_{scope}": F.when(F.col("_day").isNotNull(), since_first)
            if not faithful
            else since_first,
        }
    ).drop("_occurrences", "_day", "_first_day", "_success_day")


def successes_and_fails(df: DataFrame) -> DataFrame:
    """Successes and fails so far from the number of tries and the scores (half their sum and difference)."""
    score = F.col("score_before")
    total = score + F.col("score_before_other_language")
    same, anyway = F.col("past_occurrences_same_language"), F.col("past_occurrences_any_language")
    return df.withColumns(
        {
            "past_successes_same_language": (same + score) / 2,
            "past_fails_same_language": (same - score) / 2,
            "past_successes_any_language": (anyway + total) / 2,
            "past_fails_any_language": (anyway - total) / 2,
            "previous_score": score,
            "previous_score_other_language": F.col("score_before_other_language"),
        }
    )


def calendar(df: DataFrame) -> DataFrame:
    at = F.col("datetime")
    return df.withColumns(
        {"week_number": times.iso_week(at), "day_week": times.iso_weekday(at), "hour": times.hour_of_day(at)}
    )


def try_features(
    df: DataFrame,
    partition_by: Sequence[str] = (),
    semantics: str = "reference",
    hot_rows: int | None = None,
) -> DataFrame:
    """All history features of the tries (``df`` has ``id_session``, ``day`` and the scores).

    The place in the session is computed unless ``nb_words_session`` came with the session.

    When no learner is oversized, one shuffle on the learner serves every window below.
    """
    known = with_known_keys(df)
    if hot_rows != NEVER_HOT:
        known, hot_rows = mark_hot_groups(known, partition_by, hot_rows)
    placed = known
    if "nb_words_session" not in known.columns:
        placed = session_position(known, partition_by, hot_rows)
    rich = word_history(same_try_features(placed), partition_by, semantics, hot_rows)
    done = calendar(successes_and_fails(rich))
    return done.drop(*[c for c in done.columns if c.startswith("_")])

