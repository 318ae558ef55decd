"""Synthetic minority rows between a row and one of its nearest minority neighbours.

The neighbours are exact. Equal rows are merged into one point first; what a point's own copies leave open of the
``k`` neighbours is searched for, and only for points that give new rows. Points are cut into k-d cells: recursive
quantile cuts over their principal components, always over the component that is spread the widest. A point finds the
bound of its k-th distance in its own cell. Then cells go down the tree of boxes (in component space, where no distance is
longer than in full) and keep what lies closer than their farthest bound; at the leaves each point is held against
the box itself. The closest few blocks are visited first and tighten the bound for the others. Visits are made by pairs of
zones (subtrees of cells): a group has the points of two zones and returns, per visitor, at most k points within its
bound. Inputs travel once a pair of zones, and found neighbours travel as numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.hashing import uniform
from recall_engine.operators.global_order import dense_id
from recall_engine.staging import stage

BLOCK_ROWS = 1_024
#: Children of a tree node, and principal components that boxes have at most.
FAN, COMPONENTS = 4, 16
#: Blocks that a point visits before its bound is taken anew.
FIRST = 8
#: Levels of the tree below a zone.
ZONE_LEVELS = 2
#: Points of a cell that no component tells apart are dealt to at most so many blocks.
_PARTS = 1 << 20
PAIR_SCHEMA = "place LONG, near LONG, square DOUBLE, copies LONG"
VISIT_SCHEMA = "place LONG, home LONG, other LONG"


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _Found:
    """The k closest points (by distance, then place) of some visitors, and the squared bound that a closer one has to keep."""

    def __init__(self, count: int, k: int, reach: np.ndarray) -> None:
        self.k, self.reach = k, reach.copy()
        self.who, self.near, self.copies = (np.empty(0, np.int64) for _ in range(3))
        self.square, self.heads = np.empty(0), np.arange(count)

    def search(self, who: np.ndarray, mine: np.ndarray, places: np.ndarray, rows: np.ndarray, near: np.ndarray, copies: np.ndarray) -> None:
        """Holds the visitors ``who`` (inputs ``mine``) against ``rows``."""
        if not len(who) or not len(rows) or self.k < 1:
            return
        left, right = (mine * mine).sum(1), (rows * rows).sum(1)
        rough = left[:, None] + right[None, :] - 2.0 * (mine @ rows.T)
        rough[places[:, None] == near[None, :]] = np.inf
        bound = self.reach[who]
        open_ = np.isinf(bound)
        if open_.any() and len(rows) > self.k:
            bound[open_] = np.partition(rough[open_], self.k - 1, axis=1)[:, self.k - 1]
        # The expanded square loses digits: it picks with a margin, differences decide.
        slack = 1e-12 * (left + right.max()) + 1e-9
        i, j = np.nonzero(rough <= (bound + slack)[:, None])
        apart = places[i] != near[j]
        i, j = i[apart], j[apart]
        square = np.zeros(len(i))
        for axis in range(mine.shape[1]):
            square += (mine[i, axis] - rows[j, axis]) ** 2
        self._keep(who[i], near[j], square, copies[j])

    def _keep(self, who: np.ndarray, near: np.ndarray, square: np.ndarray, copies: np.ndarray) -> None:
        who, near = np.concatenate([self.who, who]), np.concatenate([self.near, near])
        square, copies = np.concatenate([self.square, square]), np.concatenate([self.copies, copies])
        order = np.lexsort((near, square, who))
        who = who[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        order = order[turn < self.k]
        self.who, self.near, self.square, self.copies = who[turn < self.k], near[order], square[order], copies[order]
        last = self.who[turn[turn < self.k] == self.k - 1]
        self.reach[last] = np.minimum(self.reach[last], _widened(self.square[turn[turn < self.k] == self.k - 1]))

    def table(self, places: np.ndarray) -> pa.Table:
        return pa.table({"place": places[self.who], "near": self.near, "square": self.square, "copies": self.copies})


def _widened(square):
    """A squared bound with a margin that covers rounding in the components."""
    return square * (1 + 1e-9) + 1e-9


def _parts(block: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The positions of each block."""
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, starts[1:])))


def _gaps(c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows of ``c``) to boxes."""
    total = np.zeros((len(c), len(low)))
    for axis in range(c.shape[1]):
        value = c[:, axis, None]
        gap = np.maximum(0.0, np.maximum(low[None, :, axis] - value, value - high[None, :, axis]))
        total += gap * gap
    return total


def _inside(visitors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k closest points of its own block for each visitor of a zone."""
    if not visitors.num_rows:
        return _Found(0, k, np.empty(0)).table(np.empty(0, np.int64))
    x, near, copies = _matrix(rows.column("x")), _numbers(rows, "place"), _numbers(rows, "copies")
    mine, places = _matrix(visitors.column("mine")), _numbers(visitors, "place")
    found, held = _Found(len(places), k, np.full(len(places), np.inf)), dict(_parts(_numbers(rows, "block")))
    for home, who in _parts(_numbers(visitors, "home")):
        some = held[home]
        found.search(who, mine[who], places[who], x[some], near[some], copies[some])
    return found.table(places)


def _boxes_in_reach(points: pa.Table, boxes: pa.Table, rest: bool) -> pa.Table:
    """Which boxes each point of a home has within its bound: the ``FIRST`` closest, or those after them."""
    place = other = np.empty(0, np.int64)
    if points.num_rows and boxes.num_rows:
        gaps = _gaps(_matrix(points.column("c")), _matrix(boxes.column("low")), _matrix(boxes.column("high")))
        i, j = np.nonzero(gaps <= _numbers(points, "reach")[:, None])
        order = np.lexsort((_numbers(boxes, "other")[j], gaps[i, j], i))
        i, j = i[order], j[order]
        late = np.arange(len(i)) - np.searchsorted(i, i) >= FIRST
        place, other = _numbers(points, "place")[i[late == rest]], _numbers(boxes, "other")[j[late == rest]]
    home = points.column("home")[0].as_py() if points.num_rows else 0
    return pa.table({"place": place, "home": np.full(len(place), home, np.int64), "other": other})


def _between(visitors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """What the visitors of one zone find in the blocks of another one that they visit, within their bounds."""
    found = _Found(visitors.num_rows, k, _numbers(visitors, "reach") if visitors.num_rows else np.empty(0))
    places = _numbers(visitors, "place") if visitors.num_rows else np.empty(0, np.int64)
    if visitors.num_rows and rows.num_rows:
        mine, listed = _matrix(visitors.column("mine")), visitors.column("others").combine_chunks()
        wanted = listed.flatten().to_numpy(zero_copy_only=False)
        visiting = np.repeat(np.arange(len(places)), listed.value_lengths().to_numpy(zero_copy_only=False))
        x, near, copies = _matrix(rows.column("x")), _numbers(rows, "place"), _numbers(rows, "copies")
        held = dict(_parts(_numbers(rows, "block")))
        for block, which in _parts(wanted):
            some = held[block]
            who = visiting[which]
            found.search(who, mine[who], places[who], x[some], near[some], copies[some])
    return found.table(places)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Merge candidates: per point the k closest as an array of (square, near, copies).

    The rank filter is applied before the shuffle as well, so a point with many candidates sends k of them.
    """
    rank = F.row_number().over(Window.partitionBy("place").orderBy("square", "near"))
    kept = pairs.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    found = F.array_sort(F.collect_list(F.struct("square", "near", "copies")))
    return kept.groupBy("place").agg(found.alias("nearest"))


def _components(points: DataFrame) -> tuple[DataFrame, list[float]]:
    """Adds ``c``, the leading principal components of ``x``, and gives their spreads."""
    width = points.select(F.max(F.size("x"))).first()[0] or 1
    names = [f"_x{i}" for i in range(width)]
    wide = VectorAssembler(inputCols=names, outputCol="_v").transform(points.withColumns({n: F.get("x", F.lit(i)) for i, n in enumerate(names)}))
    model = PCA(k=min(width, COMPONENTS), inputCol="_v", outputCol="_p").fit(wide)
    done = model.transform(wide).withColumn("c", vector_to_array("_p")).drop("_v", "_p", *names)
    shares = [max(float(v), 0.0) if v == v else 0.0 for v in model.explainedVariance.toArray()]
    return done, [math.sqrt(v) for v in shares]


def _cells(points: DataFrame, spreads: list[float], levels: int) -> DataFrame:
    """Adds ``cell``: the leaf of a tree of ``levels`` cuts into ``FAN`` equal parts. Only the cuts are written, a row a cell."""
    spreads = list(spreads)
    celled = points.withColumn("cell", F.lit(0).cast("long"))
    for _ in range(levels):
        widest = max(range(len(spreads)), key=spreads.__getitem__)
        spreads[widest] /= FAN
        value = F.get("c", F.lit(widest))
        parts = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
        cuts = stage(celled.groupBy("cell").agg(F.percentile_approx(value, parts, F.lit(1_000)).alias("_cuts")), "cuts")
        below = F.size(F.filter("_cuts", lambda cut: cut < value))
        celled = celled.join(cuts, "cell").withColumn("cell", F.col("cell") * FAN + below).drop("_cuts")
    return celled


def _box(points: DataFrame, by: list[str], width: int) -> DataFrame:
    edges = [f(F.get("c", F.lit(i))).alias(f"{side}{i}") for i in range(width) for side, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*by).agg(*edges)


def _apart(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    gap = F.greatest(F.lit(0.0), other_low - high, low - other_high)
    return gap * gap


def nearest_neighbours(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS, seekers: DataFrame | None = None) -> DataFrame:
    """``place`` and ``nearest``: the exact k nearest other points (square, near, copies), closest first.

    ``points`` has a unique ``place``, ``x`` (array of doubles, all different) and ``copies``, which is handed on.
    ``seekers`` names the places that search; all, if it is not given.
    """
    visits, blocked, found = _search(points, k, block_rows, seekers)
    bounded = blocked.select("place", "x").join(_reach(found, k), "place")
    return _best(_flat(found).unionByName(_visited(visits, blocked, bounded, k)), k)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("place", F.inline("nearest")).select("place", "near", "square", "copies")


def _zone(block: str) -> Column:
    """The subtree of a block; parts of one cell are in zones of their own."""
    cell = F.floor(F.col(block) / _PARTS)
    return (F.floor(cell / FAN**ZONE_LEVELS) * _PARTS + F.pmod(F.col(block), F.lit(_PARTS))).cast("long")


def _visited(visits: DataFrame, blocked: DataFrame, bounded: DataFrame, k: int) -> DataFrame:
    """What the visitors find in the blocks they visit, at most k points for each visitor and zone."""
    lists = visits.groupBy("place", _zone("home").alias("zone"), _zone("other").alias("there")).agg(F.collect_list("other").alias("others"))
    lists = stage(lists, "lists")
    visitors = lists.join(bounded.select("place", F.col("x").alias("mine"), "reach"), "place")
    wanted = lists.select(F.col("zone").alias("by"), F.col("there").alias("at")).distinct()
    hosts = blocked.select("place", "x", "copies", "block", _zone("block").alias("at")).join(wanted, "at")
    between = lambda mine, rows: _between(mine, rows, k)
    return visitors.groupBy("zone", "there").cogroup(hosts.groupBy("by", "at")).applyInArrow(between, PAIR_SCHEMA)


def _reach(found: DataFrame, k: int) -> DataFrame:
    """``place`` and the squared bound of its k-th distance; fewer than k points bound nothing."""
    farthest = F.get("nearest", F.lit(k - 1))["square"]
    return found.select("place", F.coalesce(_widened(farthest), F.lit(float("inf"))).alias("reach"))


def _search(points: DataFrame, k: int, block_rows: int, seekers: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Who still visits which block, the points with their block, and what the own block and the ``FIRST`` closest gave."""
    points, spreads = _components(stage(points.select("place", "x", "copies"), "points"))
    width = len(spreads)
    count = points.count()
    levels = max(0, math.ceil(math.log(count / block_rows, FAN))) if count else 0
    celled = stage(_cells(points, spreads, levels), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).alias("_parts"))
    part = F.pmod(F.xxhash64("place"), F.least("_parts", F.lit(_PARTS)))
    blocked = stage(celled.join(sizes, "cell").withColumn("block", F.col("cell") * _PARTS + part).drop("_parts"), "blocks")
    searching = blocked if seekers is None else blocked.join(seekers.select("place").distinct(), "place", "left_semi")
    searching = stage(searching.select("place", F.col("x").alias("mine"), "c", F.col("block").alias("home"), _zone("block").alias("by")), "searching")

    hosts = blocked.select("place", "x", "copies", "block", _zone("block").alias("zone"))
    inside = searching.groupBy("by").cogroup(hosts.groupBy("zone"))
    own = _best(inside.applyInArrow(lambda mine, rows: _inside(mine, rows, k), PAIR_SCHEMA), k)
    # A point that finds nothing in its block has an empty list.
    own = searching.select("place").join(own, "place", "left").withColumn("nearest", F.coalesce("nearest", F.expr("array()")))
    own = stage(own, "own-block")
    bounded = stage(searching.select("place", "c", "home").join(_reach(own, k), "place"), "bounded")

    leaves = stage(_box(blocked, ["cell", "block"], width), "boxes")
    edges = [f"{side}{i}" for i in range(width) for side in ("lo", "hi")]
    whole = [(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in edges]
    homes = _box(bounded, ["home"], width).join(bounded.groupBy("home").agg(F.max("reach").alias("reach")), "home")
    front = homes.withColumnsRenamed({e: f"h_{e}" for e in edges}).withColumn("node", F.lit(0).cast("long"))
    near = sum((_apart(F.col(f"h_lo{i}"), F.col(f"h_hi{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(width)), F.lit(0.0))
    for level in range(1, levels + 1):
        node = F.floor(F.col("cell") / FAN ** (levels - level)).cast("long")
        nodes = leaves.groupBy(node.alias("child")).agg(*whole).withColumn("node", F.floor(F.col("child") / FAN).cast("long"))
        front = front.join(nodes, "node").filter(near <= F.col("reach")).drop("node", *edges).withColumnRenamed("child", "node")
    pairs = front.join(leaves.withColumnRenamed("cell", "node"), "node").filter((near <= F.col("reach")) & (F.col("home") != F.col("block")))
    sides = [F.array(*[F.col(f"{side}{i}") for i in range(width)]).alias(name) for side, name in (("lo", "low"), ("hi", "high"))]
    pairs = stage(pairs.select("home", F.col("block").alias("other"), *sides), "pairs")
    among = lambda within, rest: within.groupBy("home").cogroup(pairs.groupBy("home")).applyInArrow(
        lambda mine, boxes: _boxes_in_reach(mine, boxes, rest), VISIT_SCHEMA
    )
    visitors = searching.select("place", F.col("mine").alias("x")).join(_reach(own, k), "place")
    first = _visited(stage(among(bounded, False), "visits"), blocked, visitors, k)
    found = stage(_best(_flat(own).unionByName(first), k), "closest-blocks")
    found = stage(searching.select("place").join(found, "place", "left").withColumn("nearest", F.coalesce("nearest", F.expr("array()"))), "found")
    tightened = bounded.drop("reach").join(_reach(found, k), "place")
    return stage(among(tightened, True), "visits"), blocked, found


def made_rows(minority: DataFrame, missing: int, k: int = 5, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``missing`` new rows between the rows ``x`` (arrays of doubles) of a minority.

    Columns: ``place`` (rank of the giving point among the distinct ones) and ``row`` (which of its copies), ``copy`` (which new
    row of it), ``from_x``, ``near`` and ``near_x`` (the neighbour, itself where it has copies enough), ``step`` and ``x``.
    """
    merged = minority.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    points = stage(dense_id(merged, ["x"], "place"), "minority")
    size = points.agg(F.sum("copies")).first()[0]
    k = min(k, size - 1)
    # Everyone gives the same number of new rows; the rest falls on the lowest draws.
    rows = points.select("place", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("row"))
    share = F.lit(missing // size)
    if missing % size:
        drawn = dense_id(rows.withColumn("_draw", uniform(seed, F.col("place"), F.col("row"))), ["_draw", "place", "row"], "_turn")
        rows, share = drawn, share + (F.col("_turn") < missing % size).cast("long")
    givers = stage(rows.withColumn("_share", share.cast("long")).filter("_share > 0").select("place", "row", "_share"), "givers")
    lone = points.filter(F.col("copies") <= k).join(givers, "place", "left_semi")
    near = nearest_neighbours(points, k, block_rows, lone)
    self = F.struct(F.lit(0.0).alias("square"), F.col("place").alias("near"), (F.col("copies") - 1).alias("copies"))
    listed = F.concat(F.array(self), F.coalesce("nearest", F.expr("array()")))
    expanded = F.flatten(F.transform(listed, lambda n: F.array_repeat(n, F.least(n["copies"], F.lit(k)).cast("int"))))
    known = points.join(givers.select("place").distinct(), "place", "left_semi").join(near, "place", "left")
    known = known.select("place", F.col("x").alias("from_x"), F.slice(expanded, 1, k).alias("_near"))
    copies = givers.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_share")))).drop("_share").join(known, "place")
    draw = [F.col("place"), F.col("row"), F.col("copy")]
    pick = F.floor(uniform(seed + 1, *draw) * F.size("_near")).cast("int")
    taken = copies.select("place", "row", "copy", "from_x", F.get("_near", pick).alias("_to"), uniform(seed + 2, *draw).alias("step"))
    reached = taken.withColumn("near", F.col("_to.near")).join(points.select(F.col("place").alias("near"), F.col("x").alias("near_x")), "near", "left")
    mixed = F.zip_with("from_x", "near_x", lambda a, b: a + F.col("step") * (b - a))
    return reached.select("place", "row", "copy", "from_x", "near", "near_x", "step", mixed.alias("x"))


def smote(
    dataset: DataFrame, inputs: Sequence[str], target: str, k: int = 5, seed: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``dataset`` plus synthetic rows until both classes are equally frequent.

    The inputs must be numbers without nulls. Columns besides ``inputs`` and ``target`` are dropped.
    """
    data = stage(dataset.select(*inputs, target), "smote")
    counts = {r[0]: r[1] for r in data.groupBy(target).agg(F.count(F.lit(1))).limit(3).collect()}
    if len(counts) != 2:
        raise ValueError("two classes are needed")
    rare, often = sorted(counts, key=counts.get)
    missing = counts[often] - counts[rare]
    if missing == 0:
        return data
    if counts[rare] <= 1:
        raise ValueError("a minority row needs a neighbour")
    minority = data.filter(F.col(target) == rare).select(F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"))
    made = made_rows(minority, missing, k, seed, block_rows)
    return data.unionByName(made.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(inputs)], F.lit(rare).alias(target)))
