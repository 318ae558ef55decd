"""Audit of how far sources of a language diverge in their use of words, priced on joint tables of count levels.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that stand in at
least ``least_docs`` of its documents. In each group (language, source) a kept term has a price
``p = 1 + floor(SCALE * (n + 2) / (N + 2V))``; two prices differ by ``floor((p - q)^2 / (p + q))``.

A price depends on the count alone, so terms of equal count stand on one level of the group. For a block of terms every
(group, level) is a column of zeros and ones; the product of that matrix with its transpose holds, for each pair of groups,
the joint table of their levels: how many terms stand on level a here and on level b there. Each cell is priced
once, times its number of terms. Products of blocks add up, so terms may lie in any task; rows sorted by size make blocks
of few levels, and a block with more than ``LEVELS`` columns is halved. Zeros and ones in float32 sum exactly up to
2**24, far above ``BLOCK`` terms; prices are 64-bit integers, made from decimals of 38 digits.

Words are counted per slice of texts before the shuffle, so neither a hot source nor a frequent word makes a large group.
What a task holds: a slice of text, or the counts of one term in all sources of its language, the size of one row of the
result's pair table. Pairs of sources are what the result consists of; nothing else is paired.

Defined cases: null text, language and source read as empty; each row is a document, so repeated rows and rows that
share an id count again; a group without terms, or a language without kept ones, has pairs of value 0 or of prices of zero
counts; a language of one source has no pairs; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.llm.common import LOWER, UPPER, Scratch, bytes_of, sliced, table, texts_of
from recall_engine.llm.registry import query

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: Terms in a block, columns in a product, groups in a tile of columns.
BLOCK, LEVELS, TILE = 4_096, 1_024, 64
COUNT_BYTES = 8 << 20
#: Lower-cased letters and bytes of non-ASCII characters; 0 for all that separates terms.
_TERM = np.zeros(256, np.uint8)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and how many each text has."""
    data, offsets = bytes_of(texts)
    low = _TERM[data]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(low)]
    begins[edges] |= inside[edges]  # a text that begins inside a run begins a term
    starts = np.flatnonzero(begins)
    bytes_before = np.concatenate([[0], np.cumsum(np.add.reduceat(inside, starts))]) if len(starts) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(bytes_before.astype(np.int64)), pa.py_buffer(low[inside])]
    )
    return words, np.diff(np.searchsorted(starts, offsets))


def term_counts(docs: DataFrame) -> DataFrame:
    """``_lang``, ``_source``, ``_term``, ``_n`` (occurrences) and ``_docs``; a term may have several rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", COUNT_BYTES):
            words, sizes = words_in(texts_of(batch.column(2)))
            if not len(words):
                continue
            names: dict[tuple[str, str], int] = {}
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group = np.array([names.setdefault(pair, len(names)) for pair in pairs])
            coded = words.dictionary_encode()
            distinct = len(coded.dictionary)
            code = np.asarray(coded.indices, dtype=np.int64)
            seen, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * distinct + code, return_counts=True)
            cells, at = np.unique(group[seen // distinct] * distinct + seen % distinct, return_inverse=True)
            langs, sources = zip(*names, strict=True)
            owner = pa.array(cells // distinct)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()).take(owner),
                    pa.array(sources, pa.string()).take(owner),
                    coded.dictionary.take(pa.array(cells % distinct)).cast(pa.string()),
                    pa.array(np.bincount(at, n, len(cells)).astype(np.int64)),
                    pa.array(np.bincount(at, minlength=len(cells))),
                ],
                names=["_lang", "_source", "_term", "_n", "_docs"],
            )

    return docs.mapInArrow(kernel, "_lang string, _source string, _term string, _n long, _docs long")


def _price(n: Column, total: Column, kept: Column) -> Column:
    """Exact for any 64-bit count."""
    decimal = "decimal(19,0)"
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast(decimal)
    return F.call_function("div", scaled, (total + 2 * kept).cast(decimal)) + 1


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, scratch: Scratch, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms with their counts by source, and one row a language: its kept terms, occurrences and sources."""
    counts = term_counts(docs).groupBy("_lang", "_source", "_term").agg(F.sum("_n").alias("_n"), F.sum("_docs").alias("_docs"))
    kept = counts.groupBy("_lang", "_term").agg(
        F.sum("_docs").alias("_docs"),
        F.sum("_n").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("_source", "_n"))).alias("_by"),
    )
    kept = scratch.stage(kept.filter(F.col("_docs") >= least_docs).drop("_docs"), "kept-terms", keep=True)
    sizes = kept.select("_lang", F.explode("_by").alias("_source", "_n")).groupBy("_lang", "_source").agg(F.sum("_n").alias("_size"))
    found = docs.select("_lang", "_source").distinct().join(sizes, ["_lang", "_source"], "left")
    source = F.struct("_source", F.coalesce("_size", F.lit(0).cast("long")).alias("_size"))
    sources = found.groupBy("_lang").agg(F.array_sort(F.collect_list(source)).alias("_sources"))
    whole = kept.groupBy("_lang").agg(F.count(F.lit(1)).alias("_kept"), F.sum("_total").alias("_all"))
    languages = sources.join(whole, "_lang", "left").fillna(0, ["_kept", "_all"])
    return kept, scratch.stage(languages, "languages", keep=True)


def priced_terms(kept: DataFrame, languages: DataFrame) -> DataFrame:
    """Every kept term with its price in each source (in the order of ``_sources``) and in the language."""
    count = lambda s: F.coalesce(F.element_at("_by", s["_source"]), F.lit(0).cast("long"))
    prices = F.transform("_sources", lambda s: _price(count(s), s["_size"], F.col("_kept")))
    return kept.join(languages, "_lang").withColumns({"_prices": prices, "_price": _price(F.col("_total"), F.col("_all"), F.col("_kept"))})


def _one_hot(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of (group, level), the price of each column, and the first column of each group."""
    ordered = np.sort(prices, axis=0)
    new = np.ones(ordered.shape, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    firsts = np.concatenate([[0], np.cumsum(new.sum(axis=0))[:-1]])
    levels = ordered.T[new.T]
    columns = np.empty(prices.shape, np.int64)
    for g, (first, end) in enumerate(zip(firsts, [*firsts[1:], len(levels)], strict=True)):
        columns[:, g] = first + np.searchsorted(levels[first:end], prices[:, g])
    hot = np.zeros((len(prices), len(levels)), np.float32)
    hot[np.arange(len(prices))[:, None], columns] = 1
    return hot, levels, firsts


def joint_tables(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Joint tables of the levels of two tiles of groups (terms in rows), block by block.

    Each is (cells, prices of its rows and columns, first row and column of every group).
    """
    rows, row_prices, row_firsts = _one_hot(left)
    columns, column_prices, column_firsts = _one_hot(right)
    if max(len(row_prices), len(column_prices)) > LEVELS and len(left) > 1:
        half = len(left) // 2
        yield from joint_tables(left[:half], right[:half])
        yield from joint_tables(left[half:], right[half:])
    else:
        yield rows.T @ columns, row_prices, column_prices, row_firsts, column_firsts


def divergences(prices: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each pair of tiles: their first groups and the summed differences of their groups over all terms."""
    prices = prices[np.argsort(prices.sum(axis=1), kind="stable")]
    tiles = range(0, prices.shape[1], TILE)
    for a in tiles:
        for b in tiles[a // TILE :]:
            total = np.zeros((min(TILE, prices.shape[1] - a), min(TILE, prices.shape[1] - b)), np.int64)
            for at in range(0, len(prices), BLOCK):
                block = prices[at : at + BLOCK]
                for cells, p, q, rows, columns in joint_tables(block[:, a : a + TILE], block[:, b : b + TILE]):
                    apart = p[:, None] - q
                    worth = cells.astype(np.int64) * (apart * apart // (p[:, None] + q))
                    total += np.add.reduceat(np.add.reduceat(worth, rows, axis=0), columns, axis=1)
            yield a, b, total


def pair_values(priced: DataFrame) -> DataFrame:
    """``_lang``, ``_i`` < ``_j`` (places in ``_sources``) and ``_value``, summed over all kept terms."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = np.asarray(langs.indices)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = batch.column(1).filter(pa.array(code == k))
                prices = np.asarray(pc.list_flatten(mine), dtype=np.int64).reshape(len(mine), -1)
                for a, b, total in divergences(prices):
                    i, j = np.indices(total.shape)
                    i, j, value = (i + a).ravel(), (j + b).ravel(), total.ravel()
                    once = i < j
                    columns = [pa.array([lang] * int(once.sum()), pa.string()), *[pa.array(x[once]) for x in (i, j, value)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["_lang", "_i", "_j", "_value"])

    sums = priced.select("_lang", "_prices").mapInArrow(kernel, "_lang string, _i long, _j long, _value long")
    return sums.groupBy("_lang", "_i", "_j").agg(F.sum("_value").alias("_value"))


def audit_sources(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """Columns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` kept terms that a source overuses most.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(empty(lang_col).alias("_lang"), empty(source_col).alias("_source"), F.col(text_col).alias("_text"))
    with Scratch(docs.sparkSession) as scratch:
        kept, languages = kept_terms(plain, scratch, least_docs)
    priced = priced_terms(kept, languages)
    ends = languages.select("_lang", F.posexplode("_sources").alias("_i", "_s"), "_sources")
    ends = ends.select("_lang", "_i", F.col("_s._source").alias("source"), F.posexplode("_sources").alias("_j", "_s"))
    pairs = (
        ends.filter("_i <> _j")
        .select("_lang", "source", F.col("_s._source").alias("item"), F.least("_i", "_j").alias("_i"), F.greatest("_i", "_j").alias("_j"))
        .join(pair_values(priced), ["_lang", "_i", "_j"], "left")
        .select("_lang", "source", "item", F.coalesce("_value", F.lit(0).cast("long")).alias("value"))
    )
    in_sources = F.explode(F.arrays_zip("_sources", "_prices")).alias("_in")
    terms = priced.select("_lang", "_term", "_by", "_price", in_sources)
    used = F.map_contains_key("_by", F.col("_in._sources._source")) & (F.col("_in._prices") > F.col("_price"))
    value = _difference(F.col("_in._prices"), F.col("_price"))
    terms = terms.filter(used).select("_lang", F.col("_in._sources._source").alias("source"), F.col("_term").alias("item"), value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("_lang", "source").orderBy(F.desc("value"), "item"))
    columns: Sequence[str] = ("source", "item", "value", "rank")
    first = terms.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.lit("term").alias("part"), "_lang", *columns)
    both = first.unionByName(pairs.withColumn("rank", rank).select(F.lit("pair").alias("part"), "_lang", *columns))
    return both.select(F.col("_lang").alias("lang"), "source", "part", "item", "value", "rank")


@query(
    "op12_level_products",
    rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
    ), words AS (
        SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
    ), counts AS (
        SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM words GROUP BY ALL
    ), kept AS (
        SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(d) >= {LEAST_DOCS}
    ), languages AS (
        SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY ALL
    ), groups AS (
        SELECT DISTINCT lang, source FROM docs
    ), cells AS (
        SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size
        FROM groups g JOIN kept k ON k.lang = g.lang
             LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), priced AS (
        SELECT c.lang, c.source, c.term, c.n, 1 + ({SCALE}::HUGEINT * (c.n + 2)) // (c.size + 2 * l.v) AS p,
               1 + ({SCALE}::HUGEINT * (c.total + 2)) // (l.n + 2 * l.v) AS q
        FROM cells c JOIN languages l ON l.lang = c.lang
    ), sums AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM priced WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM found
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR place <= {TOP_TERMS}
    """,
)
def op12_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))
