"""Medians by bits equal those by ranges and plain ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelry.operators import quantiles


def plain(values):
    v = sorted(x for x in values if x is not None and x == x)
    if not v:
        return None
    a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
    return a if a == b else a + (b - a) * ((len(v) - 1) / 2 - (len(v) - 1) // 2)


@pytest.mark.parametrize("n", [1, 2, 400, 401])
def test_medians_of_odd_values(spark, n):
    r = random.Random(n)
    make = [lambda: r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300), lambda: float(r.choice([0, -0.0, 1, 2])), lambda: r.choice([None, math.nan, r.random()]), lambda: r.choice([-math.inf, math.inf, 3.0]), lambda: None, lambda: -r.random()]
    rows = [tuple(m() for m in make) for _ in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(make)))).withColumn("whole", F.lit(7).cast("int"))
    got = quantiles.column_medians(df.repartition(3), [f"c{i}" for i in range(len(make))] + ["whole"])
    assert got == {**{f"c{i}": plain([row[i] for row in rows]) for i in range(len(make))}, "whole": 7.0} or any(math.isnan(x) for x in got.values() if x is not None)
    by_ranges = quantiles.exact_quantiles(df, {c: (c, 0.5) for c in got}).first()
    for c, value in got.items():
        assert value == by_ranges[c] or value is None and by_ranges[c] is None or (value is not None and (math.isnan(value) and math.isnan(by_ranges[c]) or value == pytest.approx(by_ranges[c], rel=1e-12)))


def test_no_rows(spark):
    assert quantiles.column_medians(spark.createDataFrame([], "a double, b double"), ["a", "b"]) == {"a": None, "b": None}


def test_many_columns_equal_the_builtin(spark):
    df = spark.range(2000).select(*[(F.rand(i) * 10.0**i).alias(f"c{i}") for i in range(30)])
    got = quantiles.column_medians(df, df.columns)
    assert got == pytest.approx(df.agg(*[F.median(c).alias(c) for c in df.columns]).first().asDict(), rel=1e-14)
