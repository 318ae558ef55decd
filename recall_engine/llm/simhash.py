"""SimHash near-dedup with a pigeonring filter and exact groups.

A fingerprint has bit b set if more than half of the XXH64 hashes (seed 42, UTF-8) of a text's word shingles
have it set. Equal fingerprints are one node from the start, so exact copies cost nothing further.

Pigeonring: 64 bits are cut into ``segments`` on a ring. If two fingerprints differ in at most d bits, some chain
of consecutive segments keeps, for every length l, a total difference of at most floor(l * d / segments). With
fewer differences than segments the first segment of the chain is equal, which is the key of the candidate
join, and every later budget of the chain is checked before the full Hamming distance.

Keys held by more than ``hot_rows`` fingerprints are not paired. Each of their fingerprints writes the Hamming
ball of radius d / 2 around itself (d is even). Two within d share a member of both balls, and two that share
one are within d, so a star from the smallest of those that share a member is right and loses no connection.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; rows with a null id are left out; rows that share an id are documents of
their own under one name; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import Scratch, ascii_lower, table
from recall_engine.llm.components import components
from recall_engine.llm.registry import query

SHINGLE, MOST_BITS, SEGMENTS, HOT_ROWS = 3, 2, 3, 128


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 of every shingle, repeats included; computed in the JVM."""

    def of(words: Column) -> Column:
        n = F.size(words)
        joined = lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(size)])
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < size, F.array(F.xxhash64(F.array_join(words, " "))))
            .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(joined(i))))
        )

    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(words), of)[0]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per group ``starts[i]:starts[i + 1]`` the word of bits set in over half of its hashes; 0 if it is empty."""
    out = np.zeros(len(starts) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if b > a:
            bits = np.zeros(64, np.int64)
            for c in range(a, b, 1 << 16):
                part = hashes[c : min(b, c + (1 << 16))].view(np.uint8).reshape(-1, 8)
                bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * bits > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``_id`` and ``_print`` (64 bits as a long) of every document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts = np.asarray(lists.offsets)
            hashes = np.asarray(lists.values)
            prints = majority(hashes, starts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["_id", "_print"])

    hashed = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), shingle_hashes(F.col(text_col), shingle).alias("_hashes")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return hashed.mapInArrow(kernel, f"_id {kind}, _print long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(word: Column, bound: tuple[int, int]) -> Column:
    first, width = bound
    return F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1))


def _on_ring(left: Column, right: Column, start: Column, segments: int, most_bits: int) -> Column:
    """All chain budgets from ``start`` on hold."""
    bounds = segment_bounds(segments)
    differ = left.bitwiseXOR(right)
    counts = [F.bit_count(_part(differ, b)) for b in bounds]
    held = F.lit(False)
    for first in range(segments):
        total, chain = F.lit(0), F.lit(True)
        for length in range(1, segments + 1):
            total = total + counts[(first + length - 1) % segments]
            chain = chain & (total <= length * most_bits // segments)
        held = held | ((start == first) & chain)
    return held


def links(nodes: DataFrame, scratch: Scratch, most_bits: int, segments: int, hot_rows: int) -> DataFrame:
    """``_a < _b``: pairs of fingerprints that connect all that differ in at most ``most_bits``."""
    if most_bits % 2 or not 0 <= most_bits < segments:
        raise ValueError("most_bits has to be even and smaller than the number of segments")
    bounds = segment_bounds(segments)
    keyed = nodes.select(
        "_print",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("start"), _part(F.col("_print"), b).alias("part")) for i, b in enumerate(bounds)])
        ).alias("_key"),
    ).select("_print", F.col("_key.start").alias("_start"), F.col("_key.part").alias("_part"))
    keyed = scratch.stage(keyed, "simhash-keys")
    on = ["_start", "_part"]
    sizes = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    sizes = scratch.stage(sizes, "simhash-sizes")
    cold = keyed.join(sizes.filter(F.col("_n") <= hot_rows), on, "left_semi")
    other = cold.select(*on, F.col("_print").alias("_b"))
    pairs = (
        cold.withColumnRenamed("_print", "_a")
        .join(other, on)
        .filter(F.col("_a") < F.col("_b"))
        .filter(_on_ring(F.col("_a"), F.col("_b"), F.col("_start"), segments, most_bits))
        .filter(F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= most_bits)
        .select("_a", "_b")
    )
    hot = keyed.join(sizes.filter(F.col("_n") > hot_rows), on, "left_semi").select("_print").distinct()
    masks = F.lit(_ball(64, most_bits // 2)).cast("array<bigint>")
    spread = hot.select("_print", F.explode(F.transform(masks, lambda m: F.col("_print").bitwiseXOR(m))).alias("_near"))
    centres = spread.groupBy("_near").agg(F.min("_print").alias("_a"), F.max("_print").alias("_z")).filter(F.col("_a") < F.col("_z"))
    stars = (
        spread.join(centres.select("_near", "_a"), "_near")
        .filter(F.col("_a") < F.col("_print"))
        .select("_a", F.col("_print").alias("_b"))
    )
    return pairs.unionByName(stars).distinct()


def _ball(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with at most ``radius`` set, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
    segments: int = SEGMENTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links reach."""
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints", keep=True)
        nodes = scratch.stage(prints.groupBy("_print").agg(F.min("_id").alias("_first")), "nodes")
        found = scratch.stage(links(nodes, scratch, most_bits, segments, hot_rows), "simhash-links")
        roots = components(found, scratch)
        # Only linked fingerprints have a root; the group's id is the smallest first id of its fingerprints.
        linked = scratch.stage(nodes.join(roots.withColumnRenamed("_node", "_print"), "_print"), "linked")
        smallest = linked.groupBy("_root").agg(F.min("_first").alias("_component"))
        groups = linked.join(smallest, "_root").select("_print", "_component")
        alone = nodes.join(groups, "_print", "left").select(
            F.col("_print").alias("_of"), F.coalesce("_component", "_first").alias("_component")
        )
        alone = scratch.stage(alone, "simhash-groups", keep=True)
    out = prints.join(alone, F.col("_print") == F.col("_of")).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
    return out


def keep_first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The documents whose id is the smallest of their group; rows with a null id are all kept."""
    groups = near_duplicate_groups(docs, id_col, text_col, **settings)
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    row = docs.select(F.struct("*").alias("_row"))
    return row.join(gone, F.col("_row")[id_col] == F.col("_gone"), "left_anti").select("_row.*")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
