"""Reading and writing the tables: try logs, vocabularies, word lists, predictions and trial logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine import schemas
from recall_engine.functions.times import TRY_TIME
from recall_engine.operators import history
from recall_engine.operators.global_order import dense_id
from recall_engine.operators.vocabulary import LIST_POINTS
from recall_engine.sources.versions import current, point_to

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "timestampFormat": TRY_TIME,
    "timestampNTZFormat": TRY_TIME,
}


def _csv(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    # A cell that does not fit its type is an error, not a silent null.
    return spark.read.options(**CSV_OPTIONS, mode="FAILFAST").schema(ddl).csv(path)


def _file_order() -> list[Column]:
    """Order of rows over all splits of all files: file, block, and place in the block."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ]


def read_tries(
    spark: SparkSession,
    path: str | list[str],
    partition_by: Sequence[str] = (),
    confusion_columns: bool = True,
) -> DataFrame:
    """Try log as typed rows with row id, day and session; a missing guess becomes the empty string.

    Logs from before the confusion columns have nulls there. ``partition_by`` names extra leading key
    columns (learners) of type LONG, if the files have them.
    """
    base = schemas.TRIES_DDL if confusion_columns else schemas.TRIES_WITHOUT_CONFUSION_DDL
    keys = "".join(f"{c} LONG, " for c in partition_by)
    raw = _csv(spark, path, keys + base)
    columns = raw.columns
    numbered = dense_id(raw.select("*", *_file_order()), ["_file", "_block", "_line"], history.ORDER)
    typed = numbered.select(history.ORDER, *columns).withColumns(
        {
            "id_vocab": F.col("id_vocab").cast("long"),
            "confused_word": (F.col("confused_word") if confusion_columns else F.lit(None)).cast("long"),
            "is_it_another_word": (F.col("is_it_another_word") if confusion_columns else F.lit(None)).cast("boolean"),
            "day": F.to_date("datetime"),
        }
    )
    return history.drop_marks(history.sessionize(typed.fillna({"guess": ""}), partition_by))


def read_vocab(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | str | None = None, retry_columns: bool = False
) -> DataFrame:
    """Vocabulary: id and both words by default, the given columns, or ``"all"``."""
    ddl = schemas.VOCAB_WITH_RETRY_DDL if retry_columns else schemas.VOCAB_DDL
    return _pick(_csv(spark, path, ddl), columns, ["id_vocab", "german", "english"])


def read_all_vocab(spark: SparkSession, path: str | list[str], columns: Sequence[str] | str | None = None) -> DataFrame:
    """Overall dictionary."""
    return _pick(_csv(spark, path, schemas.ALL_VOCAB_DDL), columns, ["german", "english"])


def _pick(df: DataFrame, columns: Sequence[str] | str | None, default: list[str]) -> DataFrame:
    if columns == "all":
        return df
    return df.select(*(columns or default))


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _csv(spark, path, schemas.PREDICTIONS_DDL)


def read_word_lists(spark: SparkSession, folder: str, lists: dict[str, int] | None = None) -> DataFrame:
    """Graded word lists ``<name>.csv`` with the difficulty of their name; one read per header shape."""
    points = lists or LIST_POINTS
    plain = [n for n in points if n.startswith("a")]
    graded = [n for n in points if n not in plain]
    by_name = F.create_map(*[F.lit(x) for pair in points.items() for x in pair])
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.csv", 1)
    parts = []
    for names, ddl in ((graded, schemas.GRADED_LIST_DDL), (plain, schemas.PLAIN_LIST_DDL)):
        if names:
            rows = _csv(spark, [f"{folder}/{n}.csv" for n in names], ddl)
            parts.append(rows.select("*", name.alias("list")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.withColumn("difficulty_category", F.try_element_at(by_name, F.col("list")))


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines of a text log, trimmed, with their 0-based number ``line``."""
    raw = spark.read.text(path).select("*", *_file_order())
    kept = raw.withColumn("value", F.regexp_replace("value", "^\\s+|\\s+$", "")).filter(F.col("value") != "")
    return dense_id(kept, ["_file", "_block", "_line"], "line").select("line", "value")


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV table, one file per partition."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def append_tries(tries: DataFrame, path: str) -> None:
    """Add new tries to a parquet history; what is there is not rewritten."""
    tries.write.mode("append").parquet(path)


def finish_vocab(vocab: DataFrame, path: str) -> None:
    """Write the vocabulary after a session, without the probabilities."""
    write_csv(vocab.drop("english_proba", "german_proba"), path)


def publish(predictions: DataFrame, published: str) -> str:
    """Write predictions as a new version below ``published``, then let its manifest name it. Returns the path of the version.

    A reader during or after a failed write sees the version before.
    """
    version = f"{published.rstrip('/')}/version={_stamp()}"
    write_csv(predictions, version)
    point_to(predictions.sparkSession, published, version)
    return version


def read_published(spark: SparkSession, published: str) -> DataFrame:
    """The predictions that were published last."""
    version = current(spark, published)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {published}")
    return read_predictions(spark, version)


def _stamp() -> str:
    import datetime

    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
