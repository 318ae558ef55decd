"""Model inputs: imputing, one-hot and label encoding, scaling.

Each encoder is fitted by one aggregation into a small model (a few values per column, checked) and
applied as plain column expressions, so transforming is a narrow projection without joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.operators.global_order import dense_id
from recall_engine.schemas import IMPUTE
from recall_engine.staging import stage

MAX_DUMMIES = 1_000  # one-hot columns over all variables
MAX_INLINE_CATEGORIES = 1_000  # beyond it the label index is joined instead of inlined


def impute(dataset: DataFrame, values: Mapping[str, float] = IMPUTE) -> DataFrame:
    present = {c: v for c, v in values.items() if c in dataset.columns}
    return dataset.fillna(present)


def _text_values(dataset: DataFrame, columns: Sequence[str], *others: str) -> DataFrame:
    """Long form (variable, value as text) of the given columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    return dataset.select(F.explode(pairs).alias("_pair"), *others).select("_pair.*", *others)


@dataclass(frozen=True)
class OneHot:
    """0/1 columns ``<variable>__<value>``, with ``<variable>__nan`` for missing values."""

    values: dict[str, list[str]]
    kinds: dict[str, str]

    @classmethod
    def fit(cls, dataset: DataFrame, columns: Sequence[str]) -> OneHot:
        distinct = _text_values(dataset, columns).filter(F.col("value").isNotNull()).distinct()
        rows = distinct.limit(MAX_DUMMIES + 1).collect()
        if len(rows) > MAX_DUMMIES:
            raise ValueError(f"more than {MAX_DUMMIES} categories: use SparseOneHot for these columns")
        values = {c: sorted(r.value for r in rows if r.variable == c) for c in columns}
        return cls(values, {c: dataset.schema[c].dataType.simpleString() for c in columns})

    def _name(self, column: str, value: str) -> str:
        if set(value) & set(".`"):  # would not be read as one column name
            return f"{column}__#{self.values[column].index(value)}"
        return f"{column}__{value.capitalize() if self.kinds[column] == 'boolean' else value}"

    @property
    def outputs(self) -> list[str]:
        return [n for c, vs in self.values.items() for n in [*(self._name(c, v) for v in vs), f"{c}__nan"]]

    def transform(self, dataset: DataFrame) -> DataFrame:
        """Columns as in training: an unseen value gives zeros everywhere."""
        dummies: dict[str, Column] = {}
        for column, values in self.values.items():
            for value in values:
                hit = F.coalesce(F.col(column).cast("string") == value, F.lit(False))
                dummies[self._name(column, value)] = hit.cast("double")
            dummies[f"{column}__nan"] = F.col(column).isNull().cast("double")
        return dataset.withColumns(dummies).drop(*self.values)


class SparseOneHot:
    """One sparse vector of zeros and ones per variable, whatever the number of categories.

    Categories are a table (``variable``, ``value``, ``place``), numbered in the order of their values; it is joined, not inlined, and no
    column stands for a category. The last entry of a vector is that of missing values; an unseen value gives zeros only.
    """

    def __init__(self, categories: DataFrame, sizes: dict[str, int]):
        self.categories, self.sizes = categories, sizes

    @classmethod
    def fit(cls, dataset: DataFrame, columns: Sequence[str]) -> SparseOneHot:
        distinct = _text_values(dataset, columns).filter(F.col("value").isNotNull()).distinct()
        placed = dense_id(distinct, ["variable", "value"], "_place")
        first = placed.groupBy("variable").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
        sizes = {r.variable: r["_n"] for r in first.collect()}  # one row a variable
        categories = placed.join(first, "variable").select("variable", "value", (F.col("_place") - F.col("_first")).alias("place"))
        return cls(stage(categories, "categories"), {c: sizes.get(c, 0) for c in columns})

    def output(self, column: str) -> str:
        return f"{column}__vector"

    def transform(self, dataset: DataFrame) -> DataFrame:
        """The columns replaced by their vectors."""
        done = dataset
        for column, size in self.sizes.items():
            mine = self.categories.filter(F.col("variable") == column).select(F.col("value").alias("_value"), F.col("place").alias("_place"))
            # A missing value has the last entry; an unseen one lies beyond the vector.
            place = F.when(F.col(column).isNull(), size).otherwise(F.coalesce("_place", F.lit(size + 1)))
            joined = done.join(mine, F.col(column).cast("string") == F.col("_value"), "left")
            done = joined.withColumn(f"_{column}_place", place.cast("double")).drop("_value", "_place")
        places, outputs = [f"_{c}_place" for c in self.sizes], [self.output(c) for c in self.sizes]
        largest = dataset.sparkSession.createDataFrame([tuple(float(n) for n in self.sizes.values())], places)
        # Places beyond the vector are kept as an entry of their own, which is then left out.
        encoder = OneHotEncoder(inputCols=places, outputCols=outputs, handleInvalid="keep", dropLast=True).fit(largest)
        return encoder.transform(done).drop(*places, *self.sizes)


@dataclass(frozen=True)
class Scaler:
    """Zero mean and unit population deviation; a constant column is only centred."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, dataset: DataFrame, columns: Sequence[str]) -> Scaler:
        # One aggregation over (column, value): two aggregates a column side by side are code too long to be compiled.
        long = dataset.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("place", "value"))
        found = long.groupBy("place").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()  # one row a column
        moments = {r.place: (r.m, r.s or 1.0) for r in found}
        return cls({c: moments.get(i, (None, 1.0)) for i, c in enumerate(columns)})

    def transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: (F.col(c) - m) / F.lit(s) for c, (m, s) in self.moments.items()})


@dataclass(frozen=True)
class LabelIndex:
    """Index of each value in order of first appearance; missing is a category of its own.

    ``lookup`` has (variable, value, index); ``inline`` the same as dictionaries unless there are too many.
    """

    lookup: DataFrame
    columns: tuple[str, ...]
    kinds: dict[str, T.DataType]
    inline: dict[str, dict[str | None, int]] | None

    @classmethod
    def fit(
        cls, dataset: DataFrame, columns: Sequence[str], order: str, most_inline: int | None = MAX_INLINE_CATEGORIES
    ) -> LabelIndex:
        first = _text_values(dataset, columns, order).groupBy("variable", "value").agg(F.min(order).alias("_first"))
        # Numbered over all variables at once, however many categories one has, less where each variable starts.
        numbered = dense_id(first, ["variable", "_first", F.col("value").asc_nulls_first()], "_place")
        starts = numbered.groupBy("variable").agg(F.min("_place").alias("_start"))  # one row per variable
        placed = numbered.join(F.broadcast(starts), "variable")
        lookup = placed.select("variable", "value", (F.col("_place") - F.col("_start")).cast("int").alias("index"))
        rows = lookup.collect() if most_inline is None else lookup.limit(most_inline + 1).collect()
        inline = None
        if most_inline is None or len(rows) <= most_inline:
            inline = {c: {r.value: r["index"] for r in rows if r.variable == c} for c in columns}
        kinds = {c: dataset.schema[c].dataType for c in columns}
        return cls(lookup, tuple(columns), kinds, inline)

    def transform(self, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Indexed rows, and apart from them the rows with a value unseen in training (unchanged)."""
        coded = {f"_{c}_index": c for c in self.columns}
        if self.inline is not None:
            indexed = dataset.withColumns({n: self._inline(c) for n, c in coded.items()})
        else:
            indexed = dataset
            for name, column in coded.items():
                side = self.lookup.filter(F.col("variable") == column).select(
                    F.col("value").alias("_value"), F.col("index").cast("double").alias(name)
                )
                same = indexed[column].cast("string").eqNullSafe(side["_value"])
                indexed = indexed.join(side, same, "left").drop("_value")
        seen = F.lit(True)
        for name in coded:
            seen = seen & F.col(name).isNotNull()
        kept = indexed.filter(seen)
        kept = kept.withColumns({c: F.col(n) for n, c in coded.items()}).drop(*coded)
        return kept, indexed.filter(~seen).drop(*coded)

    def _inline(self, column: str) -> Column:
        known = self.inline[column]
        return _coded(column, {v: i for v, i in known.items() if v is not None}, known.get(None))

    def as_inline(self) -> dict[str, dict]:
        """Plain values (they survive JSON): the codes of known values and the code of missing ones."""
        return {
            c: {"codes": {v: i for v, i in known.items() if v is not None}, "missing": known.get(None)}
            for c, known in self.inline.items()
        }

    def inverse(self, dataset: DataFrame) -> DataFrame:
        """Indices back to values."""
        result = dataset
        for column in self.columns:
            side = self.lookup.filter(F.col("variable") == column).select(
                F.col("value").cast(self.kinds[column]).alias("_value"), F.col("index").cast("double").alias(column)
            )
            result = result.join(side, column, "left").withColumn(column, F.col("_value")).drop("_value")
        return result.select(*dataset.columns)


def _coded(column: str, codes: dict[str, int], missing: int | None) -> Column:
    """Index of the value; null for a value (or a missing one) that training did not see."""
    entries = [e for v, i in codes.items() for e in (F.lit(v), F.lit(float(i)))]
    known = F.lit(None).cast("double")
    if entries:
        known = F.try_element_at(F.create_map(*entries), F.col(column).cast("string"))
    gap = F.lit(None if missing is None else float(missing)).cast("double")
    return F.when(F.col(column).isNull(), gap).otherwise(known)


def _coded_boolean(column: str, codes: dict[str, int], missing: int | None) -> Column:
    """As :func:`_coded`, without a text for each value."""
    code = lambda i: F.lit(None if i is None else float(i)).cast("double")
    given = F.when(F.col(column), code(codes.get("true"))).otherwise(code(codes.get("false")))
    return F.when(F.col(column).isNull(), code(missing)).otherwise(given)


def inline_codes(dataset: DataFrame, index: dict[str, dict]) -> DataFrame:
    """Values replaced by their index, an unseen one by null."""
    boolean = {f.name for f in dataset.schema if isinstance(f.dataType, T.BooleanType)}
    coded = {c: (_coded_boolean if c in boolean else _coded)(c, known["codes"], known["missing"]) for c, known in index.items()}
    return dataset.withColumns(coded)


def apply_inline_index(dataset: DataFrame, index: dict[str, dict]) -> DataFrame:
    """Replace values by their index; rows with an unseen value are left out."""
    return inline_codes(dataset, index).dropna(subset=list(index))
