"""Word and answer features as native column expressions.

Tokens are separated by exactly one space; empty tokens count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recall_engine.schemas import ENGLISH_ARTICLES, GERMAN_ARTICLES


def tokens(text: Column) -> Column:
    return F.split(text, " ", -1)


def first_token(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def character_count(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column, articles: tuple[str, ...]) -> Column:
    """Number of tokens, a leading article not counted."""
    spaces = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    return spaces + 1 - first_token(text).isin(*articles).cast("int")


def is_noun(german: Column) -> Column:
    return first_token(german).isin(*GERMAN_ARTICLES)


def is_verb(english: Column) -> Column:
    """The first English token contains "to": a substring test, so "stone" passes as well."""
    return first_token(english).contains("to")


def remove_articles(text: Column, articles: tuple[str, ...]) -> Column:
    """Drop article tokens wherever they stand."""
    return F.array_join(F.filter(tokens(text), lambda t: ~t.isin(*articles)), " ")


def translation_distance(german: Column, english: Column) -> Column:
    """Levenshtein distance of the two words, lower-cased and free of articles."""
    return F.levenshtein(
        remove_articles(F.lower(german), GERMAN_ARTICLES),
        remove_articles(F.lower(english), ENGLISH_ARTICLES),
    )


def answer_distance(german: Column, english: Column, guess: Column, asked: Column) -> Column:
    """Levenshtein distance of the guess to the answer; articles of the asked language are ignored."""
    low = F.lower(guess)
    return F.when(
        asked == "german",
        F.levenshtein(remove_articles(F.lower(german), GERMAN_ARTICLES), remove_articles(low, GERMAN_ARTICLES)),
    ).when(
        asked == "english",
        F.levenshtein(
            remove_articles(F.lower(english), ENGLISH_ARTICLES), remove_articles(low, ENGLISH_ARTICLES)
        ),
    )


def german_article(text: Column) -> Column:
    """Leading German article, or null."""
    first = first_token(text)
    return F.when(first.isin(*GERMAN_ARTICLES), first)


def correct_article(german: Column, guess: Column, asked: Column) -> Column:
    """Right article given; null unless German was asked and the answer has an article."""
    wanted = german_article(german)
    return F.when(
        (asked == "german") & wanted.isNotNull(), F.coalesce(wanted == german_article(guess), F.lit(False))
    )


def only_missed_uppercase(german: Column, guess: Column, asked: Column) -> Column:
    """The guess is the answer in lower case; null unless German was asked."""
    return F.when(
        asked == "german",
        german.rlike("\\p{IsUppercase}") & F.coalesce(F.lower(german) == guess, F.lit(False)),
    )


def count_in(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of ``word`` in ``text``; an empty word fits between all characters."""
    length = F.char_length(word)
    rest = F.char_length(F.replace(text, word, F.lit("")))
    return F.when(length == 0, F.char_length(text) + 1).otherwise(
        F.floor((F.char_length(text) - rest) / F.nullif(length, F.lit(0)))
    )


def pair_label(german: Column, english: Column) -> Column:
    """Label of a word pair; null when one side is missing."""
    return F.concat(german, F.lit(" - "), english)


# --- cleaning of raw word-list cells ---------------------------------------------------------------


def after_first_line(cell: Column) -> Column:
    """Drop the first line of a cell that has several and glue the rest."""
    lines = F.split(cell, "\n", -1)
    return F.when(F.size(lines) == 1, cell).otherwise(F.array_join(F.slice(lines, 2, F.size(lines) - 1), ""))


def split_cell(cell: Column, first: str, second: str) -> Column:
    """Struct of the first two lines; a one-line cell fills only the second field."""
    lines = F.split(cell, "\n", -1)
    single = F.size(lines) == 1
    return F.struct(
        F.when(single, F.lit("")).otherwise(F.get(lines, F.lit(0))).alias(first),
        F.when(single, F.get(lines, F.lit(0))).otherwise(F.get(lines, F.lit(1))).alias(second),
    )


# Fixed value: characters that end the usable part of a cell.
CELL_END = "[(/\\n,-]"


def tidy_word(cell: Column) -> Column:
    """Keep the part before the first bracket, slash, newline, comma or hyphen; squeeze the spaces.

    The ends lose every kind of whitespace, not only blanks.
    """
    head = F.get(F.split(cell, CELL_END, -1), F.lit(0))
    return F.trim(F.regexp_replace(head, "(?U)\\s+", " "))


def list_german(article: Column, german: Column) -> Column:
    return tidy_word(F.concat_ws(" ", article, german))


def list_english(article: Column, german: Column, english: Column) -> Column:
    """English side of a raw list row: "the" for nouns, "to" for verbs marked in the German cell."""
    named = F.when(article != "", F.concat(F.lit("the "), english)).otherwise(english)
    whole = F.concat_ws(" ", article, german)
    verb = whole.contains("(Sie") | whole.contains("(ich")
    return tidy_word(
        F.when(verb & (F.substring(named, 1, 3) != "to "), F.concat(F.lit("to "), named)).otherwise(named)
    )
