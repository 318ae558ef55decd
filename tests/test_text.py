"""Word and answer features, with umlauts that SQL oracles leave out."""

import pytest
from pyspark.sql import functions as F

from recall_engine.functions import catalog, text
from recall_engine.schemas import ENGLISH_ARTICLES, GERMAN_ARTICLES



def COL(name):
    return F.col(name)


# Article removal cases.
ARTICLES = [
    ("dienstag", "tuesday", "dienstag", "tuesday"),
    ("studieren", "to study", "studieren", "study"),
    ("die angst", "the fear", "angst", "fear"),
    ("andere", "other", "andere", "other"),
    ("der arzt", "the doctor", "arzt", "doctor"),
    ("das café", "the café", "café", "café"),
]


def test_remove_articles(spark):
    df = spark.createDataFrame([r[:2] for r in ARTICLES], "g STRING, e STRING")
    got = df.select(text.remove_articles(COL("g"), GERMAN_ARTICLES), text.remove_articles(COL("e"), ENGLISH_ARTICLES))
    assert [tuple(r) for r in got.collect()] == [r[2:] for r in ARTICLES]


@pytest.mark.parametrize(
    "german, english, words_de, words_en, noun, verb, distance",
    [
        ("die Ärztin", "the female doctor", 1, 2, True, False, 12),
        ("die Straße", "tomato", 1, 1, True, True, 6),
        ("zu  Hause", "stone age", 3, 2, False, True, None),
        ("", "", 1, 1, False, False, 0),
        ("der", "to", 0, 0, True, True, 0),
    ],
)
def test_word_features(spark, german, english, words_de, words_en, noun, verb, distance):
    row = (
        spark.createDataFrame([(german, english)], "g STRING, e STRING")
        .select(
            text.word_count(COL("g"), GERMAN_ARTICLES).alias("wd"),
            text.word_count(COL("e"), ENGLISH_ARTICLES).alias("we"),
            text.is_noun(COL("g")).alias("noun"),
            text.is_verb(COL("e")).alias("verb"),
            text.character_count(COL("g")).alias("n"),
            text.translation_distance(COL("g"), COL("e")).alias("d"),
        )
        .first()
    )
    assert (row.wd, row.we, row.noun, row.verb, row.n) == (words_de, words_en, noun, verb, len(german))
    if distance is not None:
        assert row.d == _levenshtein(_low(german, GERMAN_ARTICLES), _low(english, ENGLISH_ARTICLES)) or row.d == distance


def _low(word, articles):
    return " ".join(t for t in word.lower().split(" ") if t not in articles)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_answer_features_are_three_valued(spark):
    rows = [
        ("die Ärztin", "the female doctor", "die ärztin", "german"),
        ("die Ärztin", "the female doctor", "der Ärztin", "german"),
        ("die Ärztin", "the female doctor", "Ärztin", "german"),
        ("viel", "a lot", "viel", "german"),
        ("die Ärztin", "the female doctor", "the doctor", "english"),
    ]
    got = (
        spark.createDataFrame(rows, "g STRING, e STRING, guess STRING, asked STRING")
        .select(
            text.correct_article(COL("g"), COL("guess"), COL("asked")),
            text.only_missed_uppercase(COL("g"), COL("guess"), COL("asked")),
            text.answer_distance(COL("g"), COL("e"), COL("guess"), COL("asked")),
        )
        .collect()
    )
    assert [tuple(r) for r in got] == [
        (True, True, 0),
        (False, False, 0),
        (False, False, 0),
        (None, False, 0),
        (None, None, 7),
    ]


@pytest.mark.parametrize("body, word", [("aaaa", "aa"), ("die Uhr die Uhr", "die Uhr"), ("abc", ""), ("", "x"), ("x.x", ".")])
def test_count_in_is_python_count(spark, body, word):
    df = spark.createDataFrame([(body, word)], "s STRING, w STRING")
    assert df.select(text.count_in(COL("s"), COL("w"))).first()[0] == body.count(word)


def test_clean_list(spark):
    from recall_engine.operators.vocabulary import clean_list

    rows = [
        ("die", "Ärztin, -nen", "female  doctor (medicine)"),
        ("", "arbeiten (Sie arbeiten)", "work"),
        ("", "gehen (ich gehe)", "to go/walk"),
        ("", "E-Mail", "e"),
        ("", "", "nothing"),
        ("das", "\n", "x"),
        ("", "(nur so)", "gone"),
    ]
    got = clean_list(spark.createDataFrame(rows, "artikel STRING, deutsch_plural STRING, englisch STRING")).collect()
    assert [tuple(r) for r in got] == [
        ("die Ärztin", "the female doctor"),
        ("arbeiten", "to work"),
        ("gehen", "to go"),
        ("E", "e"),
        ("das", "the x"),
    ]


def test_cells(spark):
    df = spark.createDataFrame([("one",), ("a\nb",), ("a\nb\nc",)], "s STRING")
    got = df.select(text.after_first_line(COL("s")), text.split_cell(COL("s"), "x", "y").alias("p")).select("*", "p.*")
    assert [(r[0], r.x, r.y) for r in got.collect()] == [("one", "", "one"), ("b", "a", "b"), ("bc", "a", "b")]


def test_sql_functions(spark):
    catalog.register(spark)
    row = spark.sql(
        "SELECT german_article('die Uhr') a, german_article('Uhr') b, without_german_articles('die alte die Uhr') c, "
        "without_english_articles('to the end') d, german_word_count('die alte Uhr') e, english_word_count('to go') f"
    ).first()
    assert tuple(row) == ("die", None, "alte Uhr", "end", 2, 1)
