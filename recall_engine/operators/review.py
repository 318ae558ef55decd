"""Answer checking, score update, and the state of the vocabulary around a review session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.schemas import LANGUAGES


def expected_answer():
    return F.when(F.col("language_asked") == "german", F.col("german_word")).otherwise(F.col("english_word"))


def check_answer(tries: DataFrame) -> DataFrame:
    """Add ``is_it_correct``: the guess equals the expected word, case included."""
    return tries.withColumn("is_it_correct", F.coalesce(F.col("guess") == expected_answer(), F.lit(False)))


def _by_word(words: DataFrame, *values) -> DataFrame:
    """One row per (language, word) of a dictionary with ``german`` and ``english`` columns."""
    stacked = words.select(
        "*", F.explode(F.array(*[F.lit(x) for x in LANGUAGES])).alias("language_asked")
    ).withColumn("guess", F.when(F.col("language_asked") == "german", F.col("german")).otherwise(F.col("english")))
    return stacked.filter(F.col("guess").isNotNull()).groupBy("language_asked", "guess").agg(*values)


def flag_other_words(checked: DataFrame, all_vocab: DataFrame) -> DataFrame:
    """Add ``is_it_another_word``: is a wrong guess some word of the dictionary; null when correct.

    The right side has one row per word and so multiplies nothing.
    """
    known = _by_word(all_vocab.select("german", "english"), F.lit(True).alias("_known"))
    return (
        checked.drop("is_it_another_word")
        .join(known, ["language_asked", "guess"], "left")
        .withColumn("is_it_another_word", F.when(~F.col("is_it_correct"), F.col("_known").isNotNull()))
        .drop("_known")
    )


def resolve_confusion(flagged: DataFrame, vocab: DataFrame, order: str = "id_vocab") -> DataFrame:
    """Add ``confused_word``: id of the first vocabulary row with the guessed word, 0 if only the
    dictionary has it, null when the guess is right or no word at all."""
    first = _by_word(
        vocab.select("id_vocab", "german", "english", F.col(order).alias("_order")),
        F.min_by("id_vocab", "_order").alias("_first"),
    )
    return (
        flagged.drop("confused_word")
        .join(first, ["language_asked", "guess"], "left")
        .withColumn(
            "confused_word", F.when(F.col("is_it_another_word"), F.coalesce(F.col("_first"), F.lit(0)).cast("long"))
        )
        .drop("_first")
    )


def resolve_guesses(checked: DataFrame, vocab: DataFrame, all_vocab: DataFrame, order: str = "id_vocab") -> DataFrame:
    """:func:`flag_other_words` and :func:`resolve_confusion` together, with one join instead of two.

    Both dictionaries are merged into one row per word first. Nothing after the join relies on its
    partitioning, so AQE is free to split a guess that a large part of the tries has in common.
    """
    words = all_vocab.select(
        "german", "english", F.lit(None).cast("long").alias("_id"), F.lit(None).alias("_order"), F.lit(True).alias("_in")
    ).unionByName(
        vocab.select("german", "english", F.col("id_vocab").alias("_id"), F.col(order).alias("_order"), F.lit(False).alias("_in"))
    )
    lookup = _by_word(words, F.max("_in").alias("_known"), F.min_by("_id", "_order").alias("_first"))
    joined = checked.drop("is_it_another_word", "confused_word").join(lookup, ["language_asked", "guess"], "left")
    another = F.when(~F.col("is_it_correct"), F.coalesce("_known", F.lit(False)))
    return (
        joined.withColumn("is_it_another_word", another)
        .withColumn("confused_word", F.when(F.col("is_it_another_word"), F.coalesce("_first", F.lit(0)).cast("long")))
        .drop("_known", "_first")
    )


def score_changes(checked: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Per word (of each learner): net score change and whether it was tried, for each direction."""
    point = F.when(F.col("is_it_correct"), 1).otherwise(-1)
    german, english = F.col("language_asked") == "german", F.col("language_asked") == "english"
    return checked.groupBy(*partition_by, "id_vocab").agg(
        F.sum(F.when(english, point)).alias("_change_german_english"),
        F.sum(F.when(german, point)).alias("_change_english_german"),
    )


def apply_changes(vocab: DataFrame, changes: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add score changes to the vocabulary and mark the tried directions."""
    joined = vocab.join(changes, [*partition_by, "id_vocab"], "left")
    update = {}
    for pair in ("german_english", "english_german"):
        change = F.col(f"_change_{pair}")
        update[f"score_{pair}"] = F.col(f"score_{pair}") + F.coalesce(change, F.lit(0))
        update[f"try_session_{pair}"] = F.col(f"try_session_{pair}") | change.isNotNull()
    return joined.withColumns(update).select(*vocab.columns)


def start_session(vocab: DataFrame) -> DataFrame:
    """Forget which words were tried."""
    return vocab.withColumns(
        {"try_session_german_english": F.lit(False), "try_session_english_german": F.lit(False)}
    )


def update_vocab(vocab: DataFrame, tries: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replay tries on the vocabulary: +1 or -1 for the asked direction, and its flag set.

    With ``partition_by`` both tables have the learner columns, and a try counts for its learner alone.
    """
    return apply_changes(vocab, score_changes(check_answer(tries), partition_by), partition_by)


def not_yet_tried(vocab: DataFrame) -> DataFrame:
    return vocab.filter(~(F.col("try_session_german_english") | F.col("try_session_english_german")))


def with_probabilities(vocab: DataFrame, predictions: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Words that have predictions, with them."""
    return vocab.join(predictions, [*partition_by, "id_vocab"])


def knowledge_report(
    vocab: DataFrame, threshold: float = 0.5, few: int = 100, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Words known, words left (some direction below the threshold), and whether few are left; per learner if named."""
    left = (F.col("english_proba") < threshold) | (F.col("german_proba") < threshold)
    return vocab.groupBy(*partition_by).agg(
        F.count(F.lit(1)).alias("words"), F.count_if(F.coalesce(left, F.lit(False))).alias("words_left")
    ).select(
        *partition_by,
        "words",
        "words_left",
        (F.col("words") - F.col("words_left")).alias("words_known"),
        (F.col("words_left") < few).alias("time_to_add_words"),
    )
