"""Features of the word table, difficulty from graded lists, and growing the dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.functions import text
from recall_engine.functions.hashing import uniform
from recall_engine.operators.global_order import dense_id
from recall_engine.schemas import ENGLISH_ARTICLES, GERMAN_ARTICLES
from recall_engine.staging import stage

# Difficulty points per word list; two lists are named after their course level.
LIST_POINTS = {
    "Minus10points": -10,
    "Minus9points": -9,
    "Minus8points": -8,
    "Minus7points": -7,
    "Minus6points": -6,
    "Minus5points": -5,
    "Minus4points": -4,
    "Minus3points": -3,
    "Minus2points": -2,
    "Minus1points": -1,
    "0points": 0,
    "1points": 1,
    "2points": 2,
    "3points": 3,
    "4points": 4,
    "5points": 5,
    "a1_1": 5,
    "a1_2": 4,
}


def word_columns(vocab: DataFrame) -> DataFrame:
    """Length, word count, kind and translation distance of every word pair."""
    german, english = F.col("german"), F.col("english")
    return vocab.withColumns(
        {
            "levenshtein_distance_german_english": text.translation_distance(german, english),
            "nb_characters_german": text.character_count(german),
            "nb_characters_english": text.character_count(english),
            "nb_words_german": text.word_count(german, GERMAN_ARTICLES),
            "nb_words_english": text.word_count(english, ENGLISH_ARTICLES),
            "is_noun": text.is_noun(german),
            "is_verb": text.is_verb(english),
        }
    )


def top_difficulty(word_lists: DataFrame) -> DataFrame:
    """Highest difficulty of each pair (a pair may stand in several lists)."""
    return (
        word_lists.filter(F.col("German").isNotNull() & F.col("English").isNotNull())
        .groupBy("German", "English")
        .agg(F.max("difficulty_category").alias("difficulty_category"))
    )


def add_difficulty(vocab: DataFrame, word_lists: DataFrame) -> DataFrame:
    """Left join on the pair; each pair has one difficulty, so no word is repeated."""
    points = top_difficulty(word_lists).select(
        F.col("German").alias("german"), F.col("English").alias("english"), "difficulty_category"
    )
    return vocab.join(points, ["german", "english"], "left")


def vocab_features(vocab: DataFrame, word_lists: DataFrame) -> DataFrame:
    """Word features with the words themselves dropped."""
    return add_difficulty(word_columns(vocab), word_lists).drop("german", "english")


def graded(vocab_with_difficulty: DataFrame) -> DataFrame:
    return vocab_with_difficulty.filter(F.col("difficulty_category").isNotNull())


def all_vocab(word_lists: DataFrame) -> DataFrame:
    """The overall dictionary: every list row, repeats kept."""
    return word_lists.select(F.col("German").alias("german"), F.col("English").alias("english"))


def new_words(word_list: DataFrame, vocab: DataFrame) -> DataFrame:
    """List rows of which neither the English nor the German word is known yet."""
    english = vocab.select(F.col("english").alias("English")).distinct()
    german = vocab.select(F.col("german").alias("German")).distinct()
    return word_list.join(english, "English", "left_anti").join(german, "German", "left_anti")


def sample_words(words: DataFrame, seed: int, most: int | None = None) -> DataFrame:
    """``most`` random rows (None: all), repeatable: smallest hash of the row first.

    Adds the draw ``_draw`` and the number ``_place`` of the row. Numbering the sorted rows keeps a large
    sample out of the single task that ends a plain limit. Equal rows have equal draws and neighbour numbers.
    """
    drawn = words.withColumn("_draw", uniform(seed, F.col("German"), F.col("English")))
    placed = dense_id(drawn, ["_draw", "German", "English"], "_place")
    return placed if most is None else placed.filter(F.col("_place") < most)


def add_words(vocab: DataFrame, lists: Sequence[DataFrame], seed: int = 42) -> DataFrame:
    """Append all new words of each list, lists in priority order, with ids after the largest one.

    A later list sees the words of the earlier ones as known. Only the added rows are written, list by list, so the
    plan does not grow and the vocabulary is never copied; word lists are the only thing looped over.
    """
    spark = vocab.sparkSession
    known = vocab.select("german", "english")
    last = vocab.agg(F.coalesce(F.max("id_vocab"), F.lit(0))).first()[0]
    parts: list[DataFrame] = []
    for word_list in lists:
        numbered = sample_words(new_words(word_list.select("German", "English"), known), seed)
        added = numbered.select(
            (F.lit(last + 1) + F.col("_place")).cast("long").alias("id_vocab"),
            F.col("German").alias("german"),
            F.col("English").alias("english"),
            F.lit(0).cast("long").alias("score_german_english"),
            F.lit(0).cast("long").alias("score_english_german"),
            F.lit(False).alias("try_session_german_english"),
            F.lit(False).alias("try_session_english_german"),
        )
        part = stage(added, "new-words")
        parts.append(part)
        known = known.unionByName(part.select("german", "english"))
        last = part.agg(F.coalesce(F.max("id_vocab"), F.lit(last))).first()[0]
    added = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], vocab.schema)) if parts else None
    return vocab if added is None else vocab.unionByName(added)


def clean_list(raw: DataFrame) -> DataFrame:
    """Tidy word pairs from raw cells ``artikel, deutsch_plural, englisch``; useless rows go."""
    article, german, english = F.col("artikel"), F.col("deutsch_plural"), F.col("englisch")
    return (
        raw.filter((german != "") & (english != ""))
        .select(
            *[c for c in raw.columns if c not in ("artikel", "deutsch_plural", "englisch")],
            text.list_german(article, german).alias("deutsch"),
            text.list_english(article, german, english).alias("englisch"),
        )
        .filter((F.col("deutsch") != "") & (F.col("englisch") != ""))
    )
