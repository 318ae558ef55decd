"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but identifiers of fixed width, one document after the other, each closed by an
end-of-document identifier; it has no index. Files come as blocks of bytes cut without regard to documents. Each
block is searched for the identifier in one vectorised comparison and reduced to its separators' places. A block
knows neither how many documents end before it nor where the document open at its start began: both are
prefix scans over the blocks of a file (a sum and a running last place), after which every block turns its places into
documents by itself. The scan carries each block's list of places along, so the separators of one file pass one task.

Defined cases: an empty file or block has no document; tokens behind the last identifier make a last document marked
as not closed; a block's size has to be a whole number of identifiers, else the scan stops with an error; null
blocks are empty; repeated (file, block) pairs are an error in the input and are read one after the other, in no defined order;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.llm.common import bytes_of, sliced, table, texts_of
from recall_engine.llm.registry import query

DOCS_PER_FILE = 2048
BLOCK_TOKENS = 1 << 18
#: The byte vocabulary: a token is a byte of UTF-8, which never has 0xFF.
END_OF_DOCUMENT, WIDTH = 0xFF, 1


def write_blocks(docs: DataFrame, id_col: str, text_col: str, docs_per_file: int, block_tokens: int) -> DataFrame:
    """``file``, ``block``, ``payload``: byte tokens of the documents in id order, a file per range of ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, rest = None, 0, b""

        def out(payloads: list[bytes], first: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(payloads), pa.int64()),
                    pa.array(range(first, first + len(payloads)), pa.int64()),
                    pa.array(payloads, pa.binary()),
                ],
                names=["file", "block", "payload"],
            )

        for batch in sliced(batches, "_text"):
            files = np.asarray(batch.column(0))
            data, offsets = bytes_of(texts_of(batch.column(1)))
            edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(edges, edges[1:], strict=False):
                if files[a] != file:
                    if rest:
                        yield out([rest], block)
                    file, block, rest = int(files[a]), 0, b""
                # One separator behind each text.
                ends = offsets[a + 1 : b + 1] - offsets[a]
                stream = rest + np.insert(data[offsets[a] : offsets[b]], ends, END_OF_DOCUMENT).tobytes()
                whole = len(stream) // block_tokens
                if whole:
                    yield out([stream[k * block_tokens : (k + 1) * block_tokens] for k in range(whole)], block)
                block, rest = block + whole, stream[whole * block_tokens :]
        if rest:
            yield out([rest], block)

    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.floor(F.col(id_col) / docs_per_file).cast("long").alias("_file"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id")
    )
    placed = rows.repartition("_file").sortWithinPartitions("_file", "_id", "_text")
    return placed.select("_file", "_text").mapInArrow(kernel, "file long, block long, payload binary")


def summaries(blocks: DataFrame, end_id: int, width: int) -> DataFrame:
    """``file``, ``block``, ``_tokens`` and ``_ends`` (places of the separators inside the block)."""
    kind = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places = [], []
            for payload in batch.column(2):
                raw = payload.as_buffer() if payload.is_valid else b""
                if len(raw) % width:
                    raise ValueError("a block does not hold a whole number of identifiers")
                ids = np.frombuffer(raw, kind)
                tokens.append(len(ids))
                places.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(places, pa.list_(pa.int64()))],
                names=["file", "block", "_tokens", "_ends"],
            )

    return blocks.select("file", "block", "payload").mapInArrow(kernel, "file long, block long, _tokens long, _ends array<long>")


def scan(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, width: int = WIDTH) -> DataFrame:
    """One row per document: ``file``, ``ordinal``, ``start`` (tokens before it in the file), ``n_tokens`` (with the end
    identifier) and ``closed``."""
    found = summaries(blocks, end_id, width)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    first = F.coalesce(F.sum("_tokens").over(before), F.lit(0))
    placed = found.withColumns({"_first": first, "_last_block": F.coalesce(F.sum("_tokens").over(after), F.lit(0)) == 0})
    last = F.when(F.size("_ends") > 0, F.col("_first") + F.element_at("_ends", -1) + 1)
    stitched = placed.withColumns(
        {
            "_ordinal": F.coalesce(F.sum(F.size("_ends").cast("long")).over(before), F.lit(0)),
            "_open": F.coalesce(F.last(last, ignorenulls=True).over(before), F.lit(0)),
        }
    )
    ends = F.transform("_ends", lambda e: e + F.col("_first") + 1)
    total = F.col("_first") + F.col("_tokens")
    tail = F.when(F.size("_ends") > 0, F.element_at(ends, -1)).otherwise(F.col("_open"))
    left_over = F.when(F.col("_last_block") & (F.col("_tokens") > 0) & (tail < total), F.array(total)).otherwise(F.array().cast("array<bigint>"))
    each = stitched.select("file", "_ordinal", "_open", F.size("_ends").alias("_n"), F.concat(ends, left_over).alias("_all")).select(
        "*", F.posexplode("_all").alias("_i", "_end")
    )
    start = F.when(F.col("_i") == 0, F.col("_open")).otherwise(F.element_at("_all", F.greatest("_i", F.lit(1))))
    return each.select(
        "file",
        (F.col("_ordinal") + F.col("_i")).alias("ordinal"),
        start.alias("start"),
        (F.col("_end") - start).alias("n_tokens"),
        (F.col("_i") < F.col("_n")).alias("closed"),
    )


_SQL = f"""
SELECT CAST(doc_id // {DOCS_PER_FILE} AS BIGINT) AS file, row_number() OVER w - 1 AS ordinal,
       CAST(sum(strlen(coalesce(text, '')) + 1) OVER w AS BIGINT) - strlen(coalesce(text, '')) - 1 AS start,
       strlen(coalesce(text, '')) + 1 AS n_tokens, true AS closed
FROM documents WHERE doc_id IS NOT NULL
WINDOW w AS (PARTITION BY doc_id // {DOCS_PER_FILE} ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""


@query("op7_separator_scan", _SQL)
def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as flat files of byte tokens and counts the tokens of each from the blocks alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(write_blocks(docs, "doc_id", "text", DOCS_PER_FILE, BLOCK_TOKENS))
