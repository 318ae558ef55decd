"""Distributed numbering, running sums and quantiles against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_engine.operators.global_order import dense_id, exact_quantiles, prefix_sums
from recall_engine.operators.reports import describe


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(3)
    # half the rows share one value and one group
    data = [(i, int(x), "a" if x < 10 else "b", float(y)) for i, (x, y) in enumerate(zip(rng.randint(0, 20, 500), rng.randn(500)))]
    return data, spark.createDataFrame(data, "id LONG, x LONG, g STRING, y DOUBLE").repartition(7)


def test_dense_id(rows):
    data, df = rows
    got = {r.id: r.n for r in dense_id(df, ["x", "id"], "n", start=5).collect()}
    want = {r[0]: i + 5 for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_prefix_sums_within_groups(rows):
    data, df = rows
    got = {r.id: (r.s, r.n) for r in prefix_sums(df.withColumn("one", F.lit(1)), ["x", "id"], {"s": "x", "n": "one"}, ["g"]).collect()}
    want, sums = {}, {}
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        s, n = sums.get(r[2], (0, 0))
        sums[r[2]] = want[r[0]] = (s + r[1], n + 1)
    assert got == want


def test_exact_quantiles(rows):
    data, df = rows
    got = {r.g: (r.lo, r.q, r.hi) for r in exact_quantiles(df, "y", {"lo": 0.0, "q": 0.3, "hi": 1.0}, ["g"]).collect()}
    for g in "ab":
        y = [r[3] for r in data if r[2] == g]
        assert got[g] == pytest.approx(tuple(np.quantile(y, [0, 0.3, 1])))


def test_describe_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v DOUBLE")
    row = describe(df, "v").first()
    assert (row.n, row["mean"], row.q50, row.low, row.high) == (2, 2.5, 2.5, 1.0, 4.0)
