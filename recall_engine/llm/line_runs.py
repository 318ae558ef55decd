"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line stripped of white space at both ends, A-Z lower-cased. The store keeps what is known of
each key (documents so far, largest document id) in runs: tables bucketed and sorted by a 128-bit hash of the
key. A batch of documents is reduced to its own keys, merge-joined with the runs (keys that no run holds are
new, the anti-join part; the others carry their counts on), and written as one more run of the lowest level.
When a level holds ``FANOUT`` runs they are merged into one run of the next, so every key is rewritten a
logarithmic number of times. Of a key found in several runs, the one with the most documents is the newest.

Defined cases: a null text is one empty line and stays null when nothing is dropped; a row with a null id takes
no part and stays whole; rows that share an id count as one document, each row keeps its own lines, and equal
lines inside a document stay or go together. An empty table gives an empty table. Other columns are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import SPACES, Scratch, ascii_lower, delete, table
from recall_engine.llm.registry import query
from recall_engine.staging import new_path

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 4, 3
HASH = ["_h1", "_h2"]


def newest(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*HASH).agg(F.max("_n_docs").alias("_n_docs"), F.max("_last").alias("_last"))


class LineStore:
    """Runs by level; a context manager that drops its tables at the end."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> LineStore:
        return self

    def __exit__(self, *_: object) -> None:
        for run in [run for level in self.levels for run in level]:
            self._drop(run)

    def merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One row per key, the newest. Reads the files: a union of bucketed scans can be taken for partitioned by key."""
        schema = self.spark.table(runs[0][0]).schema
        return newest(self.spark.read.schema(schema).parquet(*[path for _, path in runs]))

    def known(self) -> DataFrame:
        """The newest state of every key in the store, which holds one run at least."""
        return self.merged([run for level in self.levels for run in level])

    def add(self, keys: DataFrame) -> None:
        """``keys``: the hash, ``_n_docs`` and ``_last`` of a batch of documents, one row per key."""
        states, lasts = [F.lit(0)], [F.col("_last")]
        for i, (name, _) in enumerate(run for level in self.levels for run in level):
            old = self.spark.table(name).select(*HASH, F.col("_n_docs").alias(f"_n{i}"), F.col("_last").alias(f"_l{i}"))
            keys = keys.join(old.hint("merge"), HASH, "left")
            states.append(F.coalesce(f"_n{i}", F.lit(0)))
            lasts.append(F.col(f"_l{i}"))
        if len(states) > 1:
            total = F.col("_n_docs") + F.greatest(*states)
            keys = keys.select(*HASH, total.alias("_n_docs"), F.greatest(*lasts).alias("_last"))
        self._put(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(self.merged(runs), level + 1)
            for run in runs:
                self._drop(run)
            level += 1

    def _put(self, keys: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        spread = keys.repartition(self.buckets, *HASH)
        spread.write.option("path", path).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        delete(self.spark, run[1])


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, batches: int) -> DataFrame:
    """Hash, batch and place of every line whose key is long enough."""
    keys = F.transform(F.split(text_col, "\n", -1), lambda x: line_key(x))
    placed = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.posexplode(keys).alias("_place", "_key")
    )
    return placed.filter(F.length("_key") >= least_chars).select(
        F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int").alias("_batch"),
        "_id",
        "_text_hash",
        "_place",
        F.xxhash64("_key").alias("_h1"),
        F.xxhash64(F.lit(1), "_key").alias("_h2"),
    )


def without(text: Column, places: Column) -> Column:
    """``text`` without the lines at these sorted places, in one pass over the lines."""

    def rest(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(places, lambda p: p + 2))
        ends = F.concat(places, F.array(F.size(lines)))
        spans = F.zip_with(starts, ends, lambda s, e: F.slice(lines, s, e - s + 1))
        return F.array_join(F.flatten(spans), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), rest)[0]


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """The documents with changed texts, plus ``n_lines`` and ``n_dropped``.

    Lines whose key has ``least_chars`` code points and stands in ``least_docs`` documents are dropped from all
    but the document with the largest id.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch, LineStore(spark, fanout) as store:
        lines = scratch.stage(_lines(docs, id_col, text_col, least_chars, batches), "lines")
        for batch in range(batches):
            own = lines.filter(F.col("_batch") == batch).select(*HASH, "_id").distinct()
            store.add(own.groupBy(*HASH).agg(F.count(F.lit(1)).alias("_n_docs"), F.max("_id").alias("_last")))
        frequent = store.known().filter(F.col("_n_docs") >= least_docs).select(*HASH, "_last")
        gone = (
            lines.join(scratch.stage(frequent, "frequent-lines"), HASH)
            .filter(F.col("_id") != F.col("_last"))
            .groupBy("_id", "_text_hash")
            .agg(F.sort_array(F.collect_set("_place")).alias("_gone"))
        )
        gone = scratch.stage(gone, "dropped-lines", keep=True)
    # The row travels as one struct, so that no column of the input can clash with those of the join.
    rows = docs.select(F.struct("*").alias("_row"))
    text = F.col("_row")[text_col]
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash"), "_gone")
    marked = rows.join(
        gone, (F.col("_row")[id_col] == F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_hash")), "left"
    )
    kept = F.when(F.col("_gone").isNull(), text).otherwise(without(text, F.col("_gone")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return marked.select(
        *[(kept if c == text_col else F.col("_row")[c]).alias(c) for c in names],
        F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, line, place, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
judged AS (
  SELECT doc_id, line, place, frequent.key IS NOT NULL AND doc_id <> last AS gone
  FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query("op8_line_runs", _SQL)
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
