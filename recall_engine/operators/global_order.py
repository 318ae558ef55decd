"""Numbering and running sums over a whole sorted table, without a single-task window.

The table is range-sorted by a total order, so equal-sized ranges come out whatever the value
distribution is. Each range is numbered on its own and shifted by the sizes of the ranges before it.
The offsets hold one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.staging import stage

_RANGE_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _sorted_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Sort globally and keep, per row, its range and its position inside the range.

    The sorted rows are written once: counting the ranges then reads one column, and no second sampling
    of the bounds can disagree with the first.
    """
    ranked = stage(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "sorted")
    return ranked.withColumns(
        {
            "_range": F.shiftright("_slot", _RANGE_BITS),
            "_in_range": F.col("_slot").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1)),
        }
    ).drop("_slot")


def dense_id(df: DataFrame, order: list[str | Column], name: str, start: int | Column = 0) -> DataFrame:
    """Number all rows ``start, start + 1, ...`` in the given order, which must be a total order."""
    ranged = _sorted_ranges(df, order)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        ranged.join(F.broadcast(offsets), "_range")  # one row per range
        .withColumn(name, (F.col("_offset") + F.col("_in_range") + first).cast("long"))
        .drop("_range", "_in_range", "_offset")
    )


def prefix_sums(
    df: DataFrame,
    order: list[str | Column],
    sums: dict[str, str],
    keys: list[str] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` in the given order, within ``keys``.

    ``totals`` adds the sum over the whole group for some of the running columns. A group may span many
    ranges, so a hot key is shared by many tasks; carries and totals come from one row per range and key.
    """
    keys, totals = keys or [], totals or {}
    ranged = _sorted_ranges(df, [*keys, *order])
    inside = (
        Window.partitionBy("_range", *keys)
        .orderBy("_in_range")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    parts = ranged.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        "_range",
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(name) for name, n in totals.items()],
    )
    on = ["_range", *keys]
    joined = local.join(carry if keys else F.broadcast(carry), on)
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop(
        "_range", "_in_range", *[f"_c_{n}" for n in sums]
    )


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], groups: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for groups of any size.

    Equal values are counted first; the running count over the sorted distinct values then locates
    the two neighbours of each quantile. No task holds the values of a group.
    """
    groups = groups or []
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    sized = prefix_sums(counts, [value], {"_through": "_n"}, groups, {"_total": "_through"})
    parts: list[Column] = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        parts.append(F.min(F.when(F.col("_through") > F.floor(position), F.col(value))).alias(f"_lo_{name}"))
        parts.append(F.min(F.when(F.col("_through") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"))
        parts.append(F.max(position - F.floor(position)).alias(f"_w_{name}"))
    found = sized.groupBy(*groups).agg(*parts)
    return found.select(
        *groups,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in quantiles
        ],
    )
