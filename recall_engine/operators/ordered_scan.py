"""Running features over ordered groups that stay exact and balanced when a group is huge.

A plain window sorts each group in one task. Here a group above ``HOT_GROUP_ROWS`` is cut into
chunks of the order key. Rows get their features inside the chunk, each chunk is summarised by a
partial aggregation, and the summaries of earlier chunks are carried into later ones. The order key
is a unique row number, so a chunk of width ``CHUNK_ROWS`` can never hold more rows than that. Groups
below the limit keep the plain window and meet no extra join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.staging import stage

HOT_GROUP_ROWS = 500_000
CHUNK_ROWS = 250_000
MAX_INLINE_HOT_GROUPS = 10_000


@dataclass(frozen=True)
class Feature:
    """One running feature; build it with the functions below."""

    kind: str
    value: Column | None = None


def rows_before() -> Feature:
    """Number of earlier rows in the group."""
    return Feature("rows_before")


def sum_before(value: Column) -> Feature:
    """Sum over earlier rows, 0 when there are none."""
    return Feature("sum_before", value)


def sum_through(value: Column) -> Feature:
    """Sum over earlier rows and this one."""
    return Feature("sum_through", value)


def previous(value: Column) -> Feature:
    """Value on the row just before, null on the first row."""
    return Feature("previous", value)


def last_before(value: Column) -> Feature:
    """Latest non-null value on an earlier row."""
    return Feature("last_before", value)


def group_min(value: Column) -> Feature:
    """Minimum over the whole group."""
    return Feature("group_min", value)


def split_hot_groups(
    df: DataFrame,
    keys: list[str],
    order: str,
    chunk: str,
    hot_rows: int | None = None,
    chunk_rows: int | None = None,
) -> tuple[DataFrame, str | None]:
    """Mark the rows of oversized groups with their chunk; returns ``(df, chunk column or None)``.

    Without keys the whole table is one group and is always chunked. With keys the groups are counted
    first (a partial aggregation over the key columns only). When none is oversized the frame comes
    back unchanged.
    """
    hot_rows = hot_rows or HOT_GROUP_ROWS
    chunk_rows = chunk_rows or CHUNK_ROWS
    position = F.floor(F.col(order) / F.lit(chunk_rows)).cast("long")
    if not keys:
        return df.withColumn(chunk, position), chunk

    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(*keys)
    found = hot.limit(MAX_INLINE_HOT_GROUPS + 1).collect()
    if not found:
        return df, None
    if len(found) <= MAX_INLINE_HOT_GROUPS:
        # A counted, small list of keys: broadcast.
        marks = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema).withColumn("_hot", F.lit(True)))
    else:
        marks = stage(hot, "hot-groups").withColumn("_hot", F.lit(True))
    marked = df.join(marks, keys, "left").withColumn(chunk, F.when(F.col("_hot"), position)).drop("_hot")
    return marked, chunk


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    features: dict[str, Feature],
    chunk: str | None = None,
) -> DataFrame:
    """Add running ``features`` over groups of ``keys`` in the order of ``order``.

    ``chunk`` is the column from :func:`split_hot_groups` for these keys or for a subset of them.
    """
    groups = [*keys, *([chunk] if chunk else [])]
    if not groups:
        raise ValueError("a scan over the whole table needs a chunk column, see split_hot_groups")
    whole = Window.partitionBy(*groups)
    ordered = whole.orderBy(order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = {n: f.value for n, f in features.items() if f.kind == "previous"}

    local: dict[str, Column] = {}
    if shifted:
        # All shifted columns travel in one struct, so the window keeps a single lag buffer.
        local["_previous"] = F.lag(F.struct(*[v.alias(n) for n, v in shifted.items()])).over(ordered)
    for name, feature in features.items():
        if feature.kind == "rows_before":
            local[name] = (F.row_number().over(ordered) - 1).cast("long")
        elif feature.kind == "sum_before":
            local[name] = F.coalesce(F.sum(feature.value).over(earlier), F.lit(0))
        elif feature.kind == "sum_through":
            local[name] = F.coalesce(F.sum(feature.value).over(through), F.lit(0))
        elif feature.kind == "last_before":
            local[name] = F.last(feature.value, ignorenulls=True).over(earlier)
        elif feature.kind == "group_min":
            local[name] = F.min(feature.value).over(whole)
    scanned = df.withColumns(local)
    if chunk:
        scanned = _carry_chunks(df, scanned, keys, groups, order, features, shifted, chunk)
    if shifted:
        scanned = scanned.withColumns({n: F.col(f"_previous.{n}") for n in shifted}).drop("_previous")
    return scanned


def _carry_chunks(df, scanned, keys, groups, order, features, shifted, chunk):
    """Add what earlier chunks of the same group contribute to the chunk-local features."""
    tops: list[Column] = []
    if shifted:
        row = F.struct(*[v.alias(n) for n, v in shifted.items()])
        tops.append(F.max_by(row, F.col(order)).alias("_t_previous"))
    for name, feature in features.items():
        if feature.kind == "rows_before":
            tops.append(F.count(F.lit(1)).alias(f"_t_{name}"))
        elif feature.kind in ("sum_before", "sum_through"):
            tops.append(F.sum(feature.value).alias(f"_t_{name}"))
        elif feature.kind == "last_before":
            known = F.when(feature.value.isNotNull(), F.col(order))
            tops.append(F.max_by(feature.value, known).alias(f"_t_{name}"))
        elif feature.kind == "group_min":
            tops.append(F.min(feature.value).alias(f"_t_{name}"))
    summary = df.filter(F.col(chunk).isNotNull()).groupBy(*groups).agg(*tops)

    # One row per group and chunk: small windows.
    across = Window.partitionBy(*(keys or [F.lit(0)]))
    in_order = across.orderBy(chunk)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    if shifted:
        carried.append(F.lag("_t_previous").over(in_order).alias("_c_previous"))
    for name, feature in features.items():
        top = f"_t_{name}"
        if feature.kind in ("rows_before", "sum_before", "sum_through"):
            carried.append(F.sum(top).over(before).alias(f"_c_{name}"))
        elif feature.kind == "last_before":
            carried.append(F.last(top, ignorenulls=True).over(before).alias(f"_c_{name}"))
        elif feature.kind == "group_min":
            carried.append(F.min(top).over(across).alias(f"_c_{name}"))
    carry = summary.select(*groups, *carried)

    joined = scanned.join(carry, groups, "left")
    merged: dict[str, Column] = {}
    if shifted:
        merged["_previous"] = F.coalesce(F.col("_previous"), F.col("_c_previous"))
    for name, feature in features.items():
        here, there = F.col(name), F.col(f"_c_{name}")
        if feature.kind in ("rows_before", "sum_before", "sum_through"):
            merged[name] = here + F.coalesce(there, F.lit(0))
        elif feature.kind == "last_before":
            merged[name] = F.coalesce(here, there)
        elif feature.kind == "group_min":
            merged[name] = F.coalesce(there, here)
    drop = [f"_c_{n}" for n, f in features.items() if f.kind != "previous"]
    return joined.withColumns(merged).drop("_c_previous", *drop)
