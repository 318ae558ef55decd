"""Merkle fixity audit of WARC records held in replicas.

A record's leaf is the SHA-256 over its bytes and its offset range in its file. Each inner node is the SHA-256 over
its up to ``FANOUT`` children in order, and covers their range. A file's root covers the file. The audit compares
the roots of two replicas and then, level by level, only the children of nodes that differ, down to the records;
whatever lies under equal nodes is never looked at again. Offsets are running sums over range-sorted tables, so a file
of any size is shared by many tasks, and nodes are made by grouping ``FANOUT`` neighbours at a time.

Defined cases: null url and html are empty strings and equal to those; a record missing in one replica shifts the
offsets behind it, and every record whose place, range or bytes differ is listed, with null where a replica
has none; rows with a null id are left out; repeated rows are records of their own, in the order of their bytes; two
empty replicas give an empty result. Columns besides id, file, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import Scratch, table
from recall_engine.llm.registry import query
from recall_engine.operators import global_order

FANOUT = 16
PAGES_PER_FILE = 4096


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC response record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, file: Column, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``_file``, ``_place`` (from 0), ``_from``, ``_to``, ``_id``, ``_hash`` of every record; no bytes are kept."""
    record = record_bytes(F.col(url_col), F.col(html_col))
    rows = pages.filter(F.col(id_col).isNotNull()).select(
        file.alias("_file"), F.col(id_col).alias("_id"), F.octet_length(record).cast("long").alias("_size"), F.sha2(record, 256).alias("_record"), F.lit(1).cast("long").alias("_one")
    )
    ordered = global_order.prefix_sums(rows, ["_id", "_record"], {"_to": "_size", "_nth": "_one"}, ["_file"])
    placed = ordered.select(
        "_file", "_id", (F.col("_nth") - 1).alias("_place"), (F.col("_to") - F.col("_size")).alias("_from"), "_to", "_record"
    )
    return placed.select(
        "_file", "_id", "_place", "_from", "_to", F.sha2(F.concat_ws(":", "_record", "_from", "_to"), 256).alias("_hash")
    )


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above; ``_place`` counts its nodes within a file."""
    children = F.sort_array(F.collect_list(F.struct("_place", "_hash")))
    return (
        nodes.withColumn("_up", F.floor(F.col("_place") / fanout).cast("long"))
        .groupBy("_file", "_up")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sha2(F.array_join(F.transform(children, lambda c: c["_hash"]), ""), 256).alias("_hash"))
        .withColumnRenamed("_up", "_place")
    )


def tree(records: DataFrame, scratch: Scratch, fanout: int) -> list[DataFrame]:
    """Levels from the records up to one root per file, each a staged table."""
    levels = [scratch.stage(records, "merkle-level")]
    most = levels[0].agg(F.max("_place")).first()[0]
    while most:
        levels.append(scratch.stage(parents(levels[-1], fanout), "merkle-level"))
        most //= fanout
    return levels


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records that differ: ``file``, ``place``, ``id``, and per side ``offset``, ``end`` and ``hash``.

    ``left`` and ``right`` are tables of ``leaves``.
    """
    with Scratch(left.sparkSession) as scratch:
        one, two = tree(left, scratch, fanout), tree(right, scratch, fanout)
        while len(one) < len(two):
            one.append(scratch.stage(parents(one[-1], fanout), "merkle-level"))
        while len(two) < len(one):
            two.append(scratch.stage(parents(two[-1], fanout), "merkle-level"))
        suspects = None
        for level in range(len(one) - 1, 0, -1):
            suspects = scratch.stage(_differing(one[level], two[level], suspects, fanout).select("_file", "_place"), "merkle-suspects")
        found = _differing(one[0], two[0], suspects, fanout)
        found = scratch.stage(found, "merkle-differences", keep=True)
    return found.select(
        F.col("_file").alias("file"),
        F.col("_place").alias("place"),
        F.coalesce("_id", "_id_r").alias("id"),
        F.col("_from").alias("left_offset"),
        F.col("_to").alias("left_end"),
        F.col("_hash").alias("left_hash"),
        F.col("_from_r").alias("right_offset"),
        F.col("_to_r").alias("right_end"),
        F.col("_hash_r").alias("right_hash"),
    )


def _differing(left: DataFrame, right: DataFrame, suspects: DataFrame | None, fanout: int) -> DataFrame:
    """Nodes of a level under the suspects of the level above that differ or stand on one side only."""
    if suspects is not None:
        above = suspects.select(F.col("_file").alias("_sf"), F.col("_place").alias("_sp"))
        under = lambda df: df.join(above, (F.col("_file") == F.col("_sf")) & (F.floor(F.col("_place") / fanout).cast("long") == F.col("_sp")), "left_semi")
        left, right = under(left), under(right)
    other = right.select("_file", "_place", *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in ("_file", "_place")])
    return left.join(other, ["_file", "_place"], "full").filter(~F.col("_hash").eqNullSafe(F.col("_hash_r")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with damage at known places: every 97th page has changed letters, every 50021st page is gone."""
    changed = F.when(F.col("page_id") % 97 == 5, F.translate("html", "e", "a")).otherwise(F.col("html"))
    return pages.filter((F.col("page_id") % 50021 != 17) | F.col("page_id").isNull()).withColumn("html", changed)


def _side(name: str, source: str) -> str:
    return f"""
{name}_records AS (
  SELECT page_id, page_id // {PAGES_PER_FILE} AS file,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''),
                chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10),
                html, chr(13), chr(10), chr(13), chr(10)) AS record
  FROM ({source})),
{name} AS (
  SELECT file, page_id AS id, row_number() OVER w - 1 AS place, CAST(sum(strlen(record)) OVER w AS BIGINT) - strlen(record) AS a,
         CAST(sum(strlen(record)) OVER w AS BIGINT) AS b, sha256(record) AS h
  FROM {name}_records WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256(record)))"""


_SQL = f"""
WITH {_side("l", "SELECT page_id, url, coalesce(html, '') AS html FROM pages")},
{_side("r", "SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN replace(coalesce(html, ''), 'e', 'a') ELSE coalesce(html, '') END AS html FROM pages WHERE page_id % 50021 <> 17")}
SELECT CAST(file AS BIGINT) AS file, place, coalesce(l.id, r.id) AS id, l.a AS left_offset, l.b AS left_end,
       CASE WHEN l.h IS NOT NULL THEN sha256(concat_ws(':', l.h, l.a, l.b)) END AS left_hash, r.a AS right_offset, r.b AS right_end,
       CASE WHEN r.h IS NOT NULL THEN sha256(concat_ws(':', r.h, r.a, r.b)) END AS right_hash
FROM l FULL JOIN r USING (file, place)
WHERE (l.h, l.a, l.b) IS DISTINCT FROM (r.h, r.a, r.b)"""

@query("op1_merkle_audit", _SQL)
def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages as WARC files of ``PAGES_PER_FILE`` ids each against a damaged replica of themselves."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    file = F.floor(F.col("page_id") / PAGES_PER_FILE).cast("long")
    sides = [leaves(p, file, "page_id", "url", "html") for p in (pages, damaged(pages))]
    return audit(*sides)
