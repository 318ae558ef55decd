"""Table schemas and the catalogue of model variables."""

from __future__ import annotations

from dataclasses import dataclass



# Column names and order of the files on disk.
TRIES_DDL = (
    "id_vocab DOUBLE, german_word STRING, english_word STRING, score_before DOUBLE, "
    "score_before_other_language DOUBLE, language_asked STRING, result DOUBLE, guess STRING, "
    "question_time DOUBLE, write_it_again STRING, confused_word DOUBLE, is_it_another_word BOOLEAN, "
    "datetime TIMESTAMP"
)
TRIES_WITHOUT_CONFUSION_DDL = (
    "id_vocab DOUBLE, german_word STRING, english_word STRING, score_before DOUBLE, "
    "score_before_other_language DOUBLE, language_asked STRING, result DOUBLE, guess STRING, "
    "question_time DOUBLE, write_it_again STRING, datetime TIMESTAMP"
)
VOCAB_DDL = (
    "id_vocab LONG, german STRING, english STRING, score_german_english LONG, "
    "score_english_german LONG, try_session_german_english BOOLEAN, try_session_english_german BOOLEAN"
)
VOCAB_WITH_RETRY_DDL = (
    "id_vocab LONG, german STRING, english STRING, score_german_english LONG, "
    "score_english_german LONG, retry_german_english DATE, retry_english_german DATE, "
    "try_session_german_english BOOLEAN, try_session_english_german BOOLEAN"
)
ALL_VOCAB_DDL = "german STRING, english STRING"
GRADED_LIST_DDL = (
    "German STRING, English STRING, Score INT, SucceedSession BOOLEAN, Succeed BOOLEAN, "
    "TrySession BOOLEAN, Retry STRING"
)
PLAIN_LIST_DDL = "German STRING, English STRING"
PREDICTIONS_DDL = "id_vocab LONG, english_proba DOUBLE, german_proba DOUBLE"

# The two directions, named by the language of the answer.
LANGUAGES = ("german", "english")
GERMAN_ARTICLES = ("der", "die", "das")
ENGLISH_ARTICLES = ("the", "to")


@dataclass(frozen=True)
class FeatureSpec:
    """Which column plays which role in a training set."""

    target: str
    numerical: tuple[str, ...]
    diff_time: tuple[str, ...]
    boolean: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def all(self) -> tuple[str, ...]:
        return self.numerical + self.diff_time + self.boolean + self.categorical

    def outside(self, columns: list[str]) -> list[str]:
        """Columns of a frame that are neither feature nor target, in frame order."""
        known = {*self.all, self.target}
        return [c for c in columns if c not in known]


# The model variables by role.
FEATURES = FeatureSpec(
    target="result",
    numerical=(
        "nb_characters_german",
        "nb_characters_english",
        "nb_words_german",
        "nb_words_english",
        "levenshtein_distance_german_english",
        "previous_score",
        "previous_score_other_language",
        "previous_levenshtein_distance_guess_answer",
        "previous_question_time",
        "previous_write_it_again_german",
        "previous_write_it_again_english",
        "past_occurrences_same_language",
        "past_successes_same_language",
        "past_fails_same_language",
        "past_occurrences_any_language",
        "past_successes_any_language",
        "past_fails_any_language",
        "week_number",
        "day_week",
        "hour",
        "nb_words_session",
        "difficulty_category",
    ),
    diff_time=(
        "days_since_last_occurrence_same_language",
        "days_since_last_occurrence_any_language",
        "days_since_last_success_same_language",
        "days_since_last_success_any_language",
        "days_since_first_occur_same_language",
        "days_since_first_occur_any_language",
    ),
    boolean=(
        "previous_result",
        "previous_correct_article",
        "previous_only_missed_uppercase",
        "previous_write_it_again_not_null",
        "is_noun",
        "is_verb",
        "previous_confused_with_another_word",
        "previous_confused_with_an_unknown_word",
    ),
    categorical=("language_asked", "previous_language_asked"),
)

# Columns whose missing value means "never happened", with the stand-in for it.
IMPUTE = {
    "previous_levenshtein_distance_guess_answer": -1.0,
    "previous_question_time": -1.0,
    "previous_write_it_again_german": -1.0,
    "previous_write_it_again_english": -1.0,
    "days_since_last_occurrence_same_language": -1.0,
    "days_since_last_occurrence_any_language": -1.0,
    "days_since_last_success_same_language": -1.0,
    "days_since_last_success_any_language": -1.0,
    "days_since_first_occur_same_language": -1.0,
    "days_since_first_occur_any_language": -1.0,
}
