"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept. All but the last return the columns of
``docs``, which may have any others besides ``doc_id`` and ``text``, with whatever names; no rows give no rows. The result is written as Parquet and read
again before the next stage, so a lost executor never costs more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm import line_runs, piece_agenda, simhash, target_ratio, winnowing
from recall_engine.llm.common import Scratch, table


OWN = ("doc_id", "text")


def _narrow(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and all else as one struct, so that no name clashes with a column that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, F.struct(*others or [F.lit(None).alias("_none")]).alias("_rest"))


def _widen(kept: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return kept.select(*[c if c in OWN else changed.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the likelihood ratio reject.

    Null, empty and blank texts go; rows with a null id and rows that share one are judged by their own texts; repeated rows
    get equal verdicts. Without rows, or without trusted documents, the ratio rejects nothing.
    """
    trusted = target_ratio.trusted_documents(table(spark, sf_dir, "labels"))
    return _widen(target_ratio.judge_quality(_narrow(docs), trusted).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share from all but the last of them; every row stays.

    ``n_chars``, where there is one, follows a changed text. Null texts become empty ones.
    """
    kept = line_runs.drop_repeated_lines(_narrow(docs))
    if "n_chars" not in docs.columns:
        return _widen(kept, docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return _widen(kept, docs, n_chars=n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every SimHash group.

    Texts without words form one group. Rows with a null id, and rows that share one, are as the operator defines them.
    """
    return _widen(simhash.keep_first_of_group(_narrow(docs), shingle=simhash.SHINGLE, most_bits=simhash.MOST_BITS), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a window with a benchmark item; all rows of an id that is hit go."""
    return _widen(winnowing.decontaminate(_narrow(docs), table(spark, sf_dir, "benchmark")), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of the ids and of the decoded text; a null text is an empty one."""
    encoded = piece_agenda.encode_and_decode(docs.select("doc_id", "text"))
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", encoding),
]
#: SQL has no 64-bit xxHash with a seed and no SentencePiece; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (name, stage) in enumerate(STAGES[:-1]):
            docs = scratch.stage(stage(spark, docs, sf_dir), name, keep=i == len(STAGES) - 2)
    return STAGES[-1][1](spark, docs, sf_dir)
