"""Fill-in-middle rearrangement of whole texts, cut by a learned rank index.

Cuts are drawn in code points, texts are UTF-8 bytes. ``RankIndex`` maps the rank of a code point to the byte it begins
at: over all boundary offsets it fits straight segments whose error stays within ``ERROR`` bytes and stores one
signed byte of residual for each rank, so a predicted offset is corrected exactly by one addition. Segments are
fitted block by block: a segment whose error is too large is halved until it fits, all segments of a level at once.

The draws come from the SHA-256 of ``seed:id``, so a row's form depends on its id alone and any task can repeat it.
``restore`` rebuilds the text from output and form.

Memory of a task follows ``SLICE_BYTES`` of text or its longest single text (a byte of residual for each code point).

Defined cases: a null or empty text, or one that contains a sentinel, is plain and its output is the text
(empty for null); a null id draws like an empty one; rows that share an id get the same draws, each on its own
length; an empty table gives an empty one. Columns named like those added are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import bytes_of, sliced, table, texts_of
from recall_engine.llm.registry import query

SEED = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PERCENT_CUT, PERCENT_SUFFIX_FIRST = 90, 20
#: Largest distance between a predicted and a true offset; residuals are signed bytes.
ERROR = 127
BLOCK_BYTES = 1 << 18
ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


class RankIndex:
    """Byte offset of every code point of UTF-8 ``data``, and of its end, as line segments with residuals."""

    def __init__(self, data: np.ndarray, block: int = BLOCK_BYTES, error: int = ERROR):
        firsts, bases, rises, runs, residuals = [], [], [], [], []
        ranks = 0
        for at in range(0, max(len(data), 1), block):
            offsets = np.flatnonzero((data[at : at + block] & 0xC0) != 0x80) + at
            if at + block >= len(data):
                offsets = np.append(offsets, len(data))
            if not len(offsets):
                continue
            first, rise, residual = _segments(offsets, error)
            firsts.append(first + ranks)
            bases.append(offsets[first])
            rises.append(rise)
            runs.append(np.maximum(np.diff(np.append(first, len(offsets))) - 1, 1))
            residuals.append(residual)
            ranks += len(offsets)
        self.first, self.base, self.rise, self.run = (np.concatenate(x) for x in (firsts, bases, rises, runs))
        self.residual = np.concatenate(residuals)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone, at most the error bound off."""
        at = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[at] + self.rise[at] * (ranks - self.first[at]) // self.run[at]

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def _segments(offsets: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rank and rise of each segment in rank order, and the residual of every rank."""
    residual = np.zeros(len(offsets), np.int8)
    done_first, done_rise = [], []
    first, end = np.zeros(1, np.int64), np.array([len(offsets)])
    while len(first):
        sizes = end - first
        rise = offsets[end - 1] - offsets[first]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = inside + np.repeat(first, sizes)
        line = np.repeat(rise, sizes) * inside // np.repeat(np.maximum(sizes - 1, 1), sizes)
        off = offsets[at] - np.repeat(offsets[first], sizes) - line
        fits = np.maximum.reduceat(np.abs(off), np.cumsum(sizes) - sizes) <= error
        keep = np.repeat(fits, sizes)
        residual[at[keep]] = off[keep]
        done_first.append(first[fits])
        done_rise.append(rise[fits])
        first, end = first[~fits], end[~fits]
        middle = (first + end) // 2
        first, end = np.concatenate([first, middle]), np.concatenate([middle, end])
    firsts, rises = np.concatenate(done_first), np.concatenate(done_rise)
    order = np.argsort(firsts)
    return firsts[order], rises[order], residual


def _draws(key: Column, seed: int) -> Column:
    """The first four 32-bit numbers of the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*map(F.lit, range(4))), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    row = F.struct(*[F.col(c) for c in docs.columns if c not in ADDED] or [F.lit(None).alias("_none")])
    marked = docs.select(row.alias("_row"), F.col(text_col).alias("_text"), _draws(F.col(id_col), seed).alias("_draws"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            texts = texts_of(batch.column(1))
            data, starts = bytes_of(texts)
            n = np.asarray(pc.utf8_length(texts), dtype=np.int64)
            draws = np.asarray(pc.list_flatten(batch.column(2)), dtype=np.int64).reshape(-1, 4)
            cuts = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
            ranks = cuts + (np.cumsum(n) - n)[:, None]
            places = RankIndex(data).offsets(ranks).tolist()
            forms, outputs = [], []
            raw, edges = data.tobytes(), starts.tolist()
            for i, (one, two) in enumerate(places):
                form, output = _arrange(raw[edges[i] : edges[i + 1]], one - edges[i], two - edges[i], draws[i, 2], draws[i, 3])
                forms.append(form)
                outputs.append(output)
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(forms, pa.string()),
                    pa.array(cuts[:, 0], mask=plain),
                    pa.array(cuts[:, 1] - cuts[:, 0], mask=plain),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                names=["_row", *ADDED],
            )

    schema = T.StructType([marked.schema["_row"], *[T.StructField(name, kind) for name, kind in ADDED.items()]])
    out = marked.mapInArrow(kernel, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def _arrange(text: bytes, one: int, two: int, whether: int, which: int) -> tuple[str, bytes]:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or p in text or s in text or m in text or whether % 100 >= PERCENT_CUT:
        return "plain", text
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if which % 100 < PERCENT_SUFFIX_FIRST:
        return "spm", b"".join((s, suffix, p, prefix, m, middle))
    return "psm", b"".join((p, prefix, s, suffix, m, middle))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No text of a cut form holds a sentinel, so the first one found is the mark."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head = F.call_function("substring_index", body, second, F.lit(1))
    rest = F.substring(body, F.length(head) + len(PREFIX) + 1, F.length(body))
    tail = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(tail) + len(MIDDLE) + 1, F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


@query(
    "op11_fill_middle",
    f"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || doc_id) AS h FROM documents
    ), numbers AS (
        SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
               ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn
    ), cut AS (
        SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                         OR h3 % 100 >= {PERCENT_CUT} THEN 'plain'
                    WHEN h4 % 100 < {PERCENT_SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM numbers
    ), parts AS (
        SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                            WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        *["doc_id", "n", "form", "prefix_chars", "middle_chars"],
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
