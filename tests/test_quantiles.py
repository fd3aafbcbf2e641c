"""Exact quantiles by nested range counts, with ranges so small that they are opened many times."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelry.operators import quantiles


def plain(values, share):
    v = sorted(x for x in values if x is not None and x == x)
    if not v:
        return None
    h = share * (len(v) - 1)
    a, b = v[math.floor(h)], v[min(math.floor(h) + 1, len(v) - 1)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


def close(a, b):
    return a is None and b is None or a == pytest.approx(b, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("few, ranges", [(10_000, 1024), (5, 64)])
def test_many_columns_and_ranks_at_once(spark, few, ranges):
    rnd = random.Random(few)
    rows = []
    for _ in range(400):
        # spread over all magnitudes, heavy repeats, one far value, NaN and nulls, infinities, a column without values
        rows.append((rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300), float(rnd.choice([0, 0, 0, 1, 2])), rnd.choice([None, math.nan, rnd.random()]), rnd.choice([-math.inf, math.inf, 3.0, rnd.random()]), None))
    rows.append((1e308, 1e300, 0.5, 0.0, None))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    wanted = {f"{c}{s}": (c, s) for c in "abcde" for s in (0.0, 0.25, 0.5, 0.9, 1.0)}
    got = quantiles.exact_quantiles(df, wanted, few=few, ranges=ranges).collect()
    assert len(got) == 1
    for name, (c, share) in wanted.items():
        assert close(got[0][name], plain([r["abcde".index(c)] for r in rows], share)), name


def test_groups_with_a_hot_one_and_a_null_one(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([rnd.randrange(50), rnd.randrange(10**9)])) for _ in range(600)] + [("void", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: (r.lo, r.mid) for r in quantiles.exact_quantiles(df, {"lo": ("v", 0.1), "mid": ("v", 0.5)}, ["g"], ranges=32, few=10).collect()}
    assert set(got) == {"hot", "b", None, "void"}
    for g, (lo, mid) in got.items():
        values = [v for k, v in rows if k == g]
        assert close(lo, plain(values, 0.1)) and close(mid, plain(values, 0.5))


def test_same_as_the_builtin(spark):
    df = spark.range(30_000).select(F.rand(7).alias("x"), (F.randn(8) * 1e6).alias("y"))
    got = quantiles.exact_quantiles(df, {"x": ("x", 0.9), "y": ("y", 0.5)}).first()
    want = df.agg(F.percentile("x", 0.9), F.median("y")).first()
    assert got.x == pytest.approx(want[0], rel=1e-14) and got.y == pytest.approx(want[1], rel=1e-14)


def test_empty_table_gives_one_row_of_nulls(spark):
    df = spark.createDataFrame([], "x double, g string")
    assert quantiles.exact_quantiles(df, {"m": ("x", 0.5)}).collect()[0].m is None
    assert quantiles.exact_quantiles(df, {"m": ("x", 0.5)}, ["g"]).count() == 0
