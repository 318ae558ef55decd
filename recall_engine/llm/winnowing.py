"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Every k-gram of words
has a hash, and a k-gram is kept if its hash is the smallest of some ``window - k + 1`` neighbouring k-grams.
Any ``window`` words that a document shares with an item hold a kept k-gram on both sides (the same one), so
joining the kept k-grams finds every place where a shared window can be. Around those places alone the
document's windows are written out as text and joined with the windows of the items, which settles each hit
exactly. Items of fewer words are one window of their own length, with k-grams and windows made to fit.

Defined cases: null and empty texts have no words; an item without words is never found; rows with a null id are
left out (documents, items); documents that share an id are reported once, with the words of the longest and the
places hit in any; repeated items count once. An empty table of documents gives an empty result, an empty benchmark no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import Scratch, ascii_lower, bytes_of, powers, sliced, table, texts_of
from recall_engine.llm.registry import query

WINDOW, GRAM = 10, 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: One random 64-bit value for each byte.
_VALUE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start and end of every word in them; the first word of each text (and the end)."""
    data, offsets = bytes_of(texts)
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _IN_WORD[low]
    change = inside[1:] != inside[:-1]
    # A text that begins inside a run of word bytes begins a word.
    cut = offsets[1:-1]
    cut = cut[cut < len(low)]
    cut = cut[inside[cut + 1] & inside[cut]]
    starts = np.union1d(np.flatnonzero(change & inside[1:]), cut)
    ends = np.union1d(np.flatnonzero(change & inside[:-1]), cut)
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word modulo 2**64, from one running sum over all bytes."""
    sums = np.zeros(len(low) + 1, np.uint64)
    bits = max(12, len(low).bit_length())
    np.cumsum(_VALUE[low] * powers(_BASE, bits)[: len(low)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, bits)[starts]
    raw ^= raw >> np.uint64(29)
    return raw * np.uint64(0xBF58476D1CE4E5B9)


def kept_grams(hashes: np.ndarray, firsts: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the k-grams that winnowing keeps; none crosses from one text into the next."""
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(gram):
        mixed = mixed * np.uint64(0x100000001B3) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(30)
    crossing = np.zeros(len(hashes) + 1, np.int32)
    for back in range(1, gram):
        at = firsts[1:-1] - back
        crossing[at[(at >= 0) & (at >= firsts[:-2])]] = 1
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    valid = crossing[:n] == 0
    mixed = np.where(valid, np.minimum(mixed, worst - np.uint64(1)), worst)
    wide = max(1, window - gram + 1)
    padded = np.concatenate([np.full(wide - 1, worst), mixed, np.full(wide - 1, worst)])
    least = padded[: n + wide - 1].copy()
    for i in range(1, wide):
        np.minimum(least, padded[i : i + n + wide - 1], out=least)
    most = least[:n].copy()
    for i in range(1, wide):
        np.maximum(most, least[i : i + n], out=most)
    places = np.flatnonzero(valid & (mixed == most))
    return mixed[places], places


def kept_table(texts: DataFrame, id_col: str, text_col: str, classes: list[tuple[int, int]]) -> DataFrame:
    """``_id``, ``_gram`` (hash), ``_place``, ``_window``: the kept k-grams for every (gram, window) of ``classes``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            ids = batch.column(0)
            low, starts, ends, firsts = words_of(texts_of(batch.column(1)))
            hashes = word_hashes(low, starts, ends)
            for gram, window in classes:
                found, places = kept_grams(hashes, firsts, gram, window)
                owner = np.searchsorted(firsts, places, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner)),
                        pa.array(found.view(np.int64)),
                        pa.array((places - firsts[owner]).astype(np.int32)),
                        pa.array(np.full(len(places), window, np.int32)),
                    ],
                    names=["_id", "_gram", "_place", "_window"],
                )

    kind = texts.schema[id_col].dataType.simpleString()
    plain = texts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(kernel, f"_id {kind}, _gram long, _place int, _window int")


def window_table(texts: DataFrame, grams: dict[int, int]) -> DataFrame:
    """Word counts and the windows around candidate places, one row for each row of ``texts``.

    ``texts``: ``_id``, ``_text``, ``_at`` (structs of ``_window`` and ``_place``, or null). Output: ``_id``, ``_words``, ``_spans`` (structs of
    ``start``, ``size`` and ``words``), a span for each window that holds one of the places.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            low, starts, ends, firsts = words_of(texts_of(batch.column(1)))
            data, counts = low.tobytes(), np.diff(firsts)
            spans: list[list[dict] | None] = []
            for row, places in enumerate(batch.column(2).to_pylist()):
                first, n = int(firsts[row]), int(counts[row])
                wanted = {
                    (begin, p["_window"])
                    for p in places or ()
                    for begin in range(
                        max(0, p["_place"] + grams[p["_window"]] - p["_window"]), min(p["_place"], n - p["_window"]) + 1
                    )
                }
                spans.append(
                    [
                        {
                            "start": begin,
                            "size": size,
                            "words": " ".join(
                                data[starts[w] : ends[w]].decode() for w in range(first + begin, first + begin + size)
                            ),
                        }
                        for begin, size in sorted(wanted)
                    ]
                )
            kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(spans, kind)], names=["_id", "_words", "_spans"]
            )

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(kernel, f"_id {kind}, _words long, _spans array<struct<start:int,size:int,words:string>>")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``_item``, ``_size`` and ``_text``: each distinct window of every item, words joined by a blank."""
    words = F.regexp_extract_all(
        ascii_lower(F.col(text_col)),
        F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
        F.lit(0),
    )
    split = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_item"), words.alias("_words"))
    split = split.filter(F.size("_words") > 0).withColumn("_size", F.least(F.lit(window), F.size("_words")))
    begins = F.sequence(F.lit(1), F.size("_words") - F.col("_size") + 1)
    return (
        split.select("_item", "_size", "_words", F.explode(begins).alias("_begin"))
        .select("_item", "_size", F.array_join(F.slice("_words", F.col("_begin"), F.col("_size")), " ").alias("_text"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document id: ``n_words``, ``n_hit`` (words inside a shared window) and ``items`` found (sorted)."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        windows = scratch.stage(item_windows(items, item_id, item_text, window), "item-windows")
        sizes = [r[0] for r in windows.select("_size").distinct().collect()]  # at most `window` rows
        classes = {size: min(gram, size) for size in sizes}
        pairs = [(g, size) for size, g in classes.items()]
        # The windows of a size class are short texts themselves; each gives one kept k-gram or more.
        grams = kept_table(windows.withColumn("_own", F.col("_size")), "_own", "_text", pairs)
        grams = scratch.stage(grams.filter("_window = _id").select("_gram", "_window").distinct(), "item-grams")
        found = kept_table(docs, id_col, text_col, pairs).join(grams, ["_gram", "_window"], "left_semi")
        found = scratch.stage(found.groupBy("_id").agg(F.collect_set(F.struct("_window", "_place")).alias("_at")), "candidates")
        plain = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        spans = scratch.stage(window_table(plain.join(found, "_id", "left").select("_id", "_text", "_at"), classes), "spans", keep=True)
        each = spans.filter(F.size("_spans") > 0).select("_id", F.posexplode("_spans").alias("_nth", "_span"))
        each = each.select("_id", F.col("_span.start").alias("_start"), F.col("_span.size").alias("_size"), F.col("_span.words").alias("_text"))
        hits = scratch.stage(each.join(windows, ["_size", "_text"]).groupBy("_id").agg(
            F.collect_set(F.struct("_start", "_size")).alias("_hits"),
            F.collect_set(F.col("_item").cast("string")).alias("_items"),
        ), "hits", keep=True)
    covered = F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["_start"], h["_start"] + h["_size"] - 1)))))
    counted = spans.groupBy("_id").agg(F.max("_words").alias("n_words"))
    return counted.join(hits, "_id", "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.sort_array("_items"), F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """The documents without a shared window, all columns kept; rows with a null id stay."""
    dirty = contamination(docs, items, id_col, **settings).filter(F.col("n_hit") > 0).select(F.col(id_col).alias("_dirty"))
    row = docs.select(F.struct("*").alias("_row"))
    return row.join(dirty, F.col("_row")[id_col] == F.col("_dirty"), "left_anti").select("_row.*")


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_SQL = f"""
WITH words AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[b:b + k - 1], ' ') AS t
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS b FROM sized)),
spans AS (
  SELECT doc_id, b, k, array_to_string(w[b:b + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS b
        FROM words, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, b, k, item_id FROM spans JOIN item_windows USING (k, t)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(b, b + k)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op2_winnowing", _SQL)
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
