"""Text functions for SQL users, registered as SQL-bodied temporary functions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "german_article": (
        "word STRING",
        "STRING",
        "CASE WHEN substring_index(word, ' ', 1) IN ('der', 'die', 'das') THEN substring_index(word, ' ', 1) END",
    ),
    "without_german_articles": (
        "word STRING",
        "STRING",
        "array_join(filter(split(word, ' ', -1), t -> t NOT IN ('der', 'die', 'das')), ' ')",
    ),
    "without_english_articles": (
        "word STRING",
        "STRING",
        "array_join(filter(split(word, ' ', -1), t -> t NOT IN ('the', 'to')), ' ')",
    ),
    "german_word_count": (
        "word STRING",
        "INT",
        "size(split(word, ' ', -1)) - CAST(substring_index(word, ' ', 1) IN ('der', 'die', 'das') AS INT)",
    ),
    "english_word_count": (
        "word STRING",
        "INT",
        "size(split(word, ' ', -1)) - CAST(substring_index(word, ' ', 1) IN ('the', 'to') AS INT)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
