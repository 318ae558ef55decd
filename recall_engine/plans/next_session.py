"""The whole preparation of a session, and the report after it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from recall_engine.operators import datasets, history, review, vocabulary
from recall_engine.plans import models
from recall_engine.staging import stage


WORD_COLUMNS = (
    "levenshtein_distance_german_english",
    "nb_characters_german",
    "nb_characters_english",
    "nb_words_german",
    "nb_words_english",
    "is_noun",
    "is_verb",
    "difficulty_category",
)


@dataclass
class Prepared:
    """Results of :func:`prepare`."""

    model: models.FittedModel
    quality: DataFrame
    predictions: DataFrame
    dataset: DataFrame


def training_rows(
    tries: DataFrame, vocab: DataFrame, word_lists: DataFrame, partition_by: Sequence[str] = (), semantics: str = "reference"
) -> DataFrame:
    """Features of all tries with the features of their words."""
    words = _word_features(vocab, word_lists, partition_by)
    return datasets.training_set(history.try_features(tries, partition_by, semantics), words)


def _word_features(vocab: DataFrame, word_lists: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """One row per word; with learners, ``vocab`` has a word once per learner."""
    words = vocab.select("id_vocab", "german", "english")
    if partition_by:
        words = words.dropDuplicates(["id_vocab"])
    return vocabulary.vocab_features(words, word_lists).select("id_vocab", *WORD_COLUMNS)


def next_session_rows(
    tries: DataFrame,
    vocab: DataFrame,
    word_lists: DataFrame,
    now: Column,
    partition_by: Sequence[str] = (),
    semantics: str = "reference",
) -> DataFrame:
    """Features of every graded word in both directions at ``now``."""
    future = datasets.future_tries(vocab, datasets.last_ids(tries, partition_by), now, partition_by)
    features = datasets.next_session_features(tries, future, partition_by, semantics)
    words = vocabulary.graded(_word_features(vocab, word_lists, partition_by))
    return datasets.training_set(features, words)


def score_next_session(model, rows: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Probability per word, one column per direction."""
    return datasets.probabilities_by_word(model.predict(rows), partition_by)


def prepare(
    tries: DataFrame,
    vocab: DataFrame,
    word_lists: DataFrame,
    now: Column,
    settings: models.BoostingSettings = models.BoostingSettings(),
    partition_by: Sequence[str] = (),
    semantics: str = "reference",
) -> Prepared:
    """Features, split, training, evaluation on the validation sessions, and scores of the next session.

    The training rows are read by several jobs and are written once.
    """
    rows = training_rows(tries, vocab, word_lists, partition_by, semantics)
    dataset = stage(datasets.split_by_session(rows, partition_by), "dataset")
    train, valid = dataset.filter("split = 'train'"), dataset.filter("split = 'valid'")
    model = models.fit_boosting(train, settings, valid)
    coming = next_session_rows(tries, vocab, word_lists, now, partition_by, semantics)
    return Prepared(model, model.evaluate(valid), score_next_session(model, coming, partition_by), dataset)


def post_review_report(vocab: DataFrame, predictions: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Words known and left once the new probabilities are in."""
    joined = review.with_probabilities(vocab, predictions, partition_by)
    return review.knowledge_report(joined, partition_by=partition_by)
