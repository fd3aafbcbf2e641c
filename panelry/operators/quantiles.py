"""Exact quantiles of many columns, ranks and groups at once, by nested range counts.

The values between the smallest and the largest are counted in ranges of equal width; the range that a rank falls into is
opened and counted again between its own smallest and largest value (in turn by the values and by their roots), until it
holds few values or a single one. Only counts are shuffled, so that no task ever holds a column's distinct values, and every
column, rank and group is opened in the same pass. The smallest and the largest value of a range have a range each, so that values far out or often repeated part at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .align import dimension
from .store import discard, stored

#: Ranges that an open range is cut into, and values that are few enough to be sorted in one task.
RANGES, FEW = 1024, 10_000
#: Passes after which a search is given up as broken; values of all magnitudes take about six.
PASSES = 100
LARGEST = 1.7976931348623157e308


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def _range_of(x: str, low: str, high: str, ranges: int, roots: bool) -> Column:
    """0 for the smallest value, ranges - 1 for the largest, by width in between; never falls as x grows.

    The widths are those of the values, or of their 64th roots: a square root is rounded correctly, so it never falls
    either, and roots part values of all magnitudes at once. Halves are subtracted, as the width of all doubles is none.
    """

    def at(v: Column) -> Column:
        v = F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST))
        if roots:
            size = F.abs(v)
            for _ in range(6):
                size = F.sqrt(size)
            v = F.signum(v) * size
        return v / 2

    a, b, v = at(F.col(low)), at(F.col(high)), at(F.col(x))
    inner = F.when(b > a, F.least(F.floor((v - a) / (b - a) * (ranges - 2)), F.lit(ranges - 3))).otherwise(0)
    return F.when(F.col(x) <= F.col(low), F.lit(0)).when(F.col(x) >= F.col(high), F.lit(ranges - 1)).otherwise(1 + inner).cast("int")


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str] | None = None, ranges: int = RANGES, few: int = FEW, copy: bool = True) -> DataFrame:
    """One row, or one per group, with a column for each name in wanted: the (column, share) quantile of it.

    Quantiles interpolate linearly between the two values next to place share * (n - 1); nulls and NaN are skipped, and a
    column without values gives null. A null group is a group. The table is read once and its columns stored, unless copy is
    false: a table that is stored already is read again in every pass. The result is stored, too, and has as many rows as
    there are groups.
    """
    by = by or []
    columns = sorted({c for c, _ in wanted.values()})
    keys = [f"_k{i}" for i in range(len(by))]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wide = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    wide = stored(wide) if copy else wide
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_v{i}").alias("x")) for i in range(len(columns))])
    values = wide.select(*keys, F.inline(each)).where("x is not null")
    known = stored(values.groupBy(*keys, "c").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    spent = [wide, known]
    # Every place that an interpolation needs, once: c, place.
    at = F.array(*[F.struct(F.lit(columns.index(c)).alias("c"), F.lit(float(share)).alias("share")) for c, share in sorted(set(wanted.values()))])
    asked = known.select("*", F.explode(at).alias("a")).where("a.c = c").select(*keys, "c", "n", "low", "high", F.col("a.share").alias("share"))
    place = F.floor(F.col("share") * (F.col("n") - 1))
    both = F.explode(F.array(place, F.least(place + 1, F.col("n") - 1)))
    open_ = stored(asked.select(*keys, "c", both.alias("place"), F.lit(0).cast("long").alias("below"), "n", "low", "high").distinct())
    spent.append(open_)
    done = []
    side = [f"_o{i}" for i in range(len(by))] + ["_oc"]
    rename = dict(zip([*keys, "c", "low", "high"], [*side, "_low", "_high"], strict=True))
    inside = lambda ranges_: values.join(dimension(ranges_), _same([*keys, "c"], side) & (F.col("x") >= F.col("_low")) & (F.col("x") <= F.col("_high")))
    for k in range(PASSES):
        done.append(open_.where((F.col("n") <= few) | (F.col("low") == F.col("high"))))
        open_ = open_.where((F.col("n") > few) & (F.col("low") < F.col("high")))
        if open_.isEmpty():
            break
        hit = inside(open_.select(*keys, "c", "low", "high").distinct().withColumnsRenamed(rename))
        hit = hit.groupBy(*side, "_low", "_high", _range_of("x", "_low", "_high", ranges, k % 2 == 1).alias("r"))
        counts = hit.agg(F.count("x").alias("m"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = F.sum("m").over(W.partitionBy(*side, "_low", "_high").orderBy("r").rowsBetween(W.unboundedPreceding, W.currentRow))
        counts = stored(counts.withColumn("upto", upto))
        rest = F.col("place") - F.col("below")
        found = open_.join(dimension(counts), _same([*keys, "c", "low", "high"], [*side, "_low", "_high"]) & (rest < F.col("upto")) & (rest >= F.col("upto") - F.col("m")))
        open_ = stored(found.select(*keys, "c", "place", (F.col("below") + F.col("upto") - F.col("m")).alias("below"), F.col("m").alias("n"), F.col("a").alias("low"), F.col("b").alias("high")))
        spent += [counts, open_]
    else:
        raise RuntimeError("the ranges did not narrow")
    settled = reduce(DataFrame.union, done)
    single = settled.where("low = high").select(*keys, "c", "place", F.col("low").alias("value"))
    several = settled.where("low < high")
    listed = inside(several.select(*keys, "c", "low", "high").distinct().withColumnsRenamed(rename)).groupBy(*side, "_low", "_high").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    several = several.join(listed, _same([*keys, "c", "low", "high"], [*side, "_low", "_high"]))
    several = several.select(*keys, "c", "place", F.get("xs", (F.col("place") - F.col("below")).cast("int")).alias("value"))
    found = single.union(several).groupBy(*keys, "c").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))
    per = known.join(found.withColumnsRenamed(dict(zip([*keys, "c"], side, strict=True))), _same([*keys, "c"], side))
    cells = []
    for name, (c, share) in wanted.items():
        h = F.lit(float(share)) * (F.col("n") - 1)
        a, b = F.element_at("at", F.floor(h)), F.element_at("at", F.least(F.floor(h) + 1, F.col("n") - 1))
        value = F.when(a == b, a).otherwise(a + (b - a) * (h - F.floor(h)))
        cells.append(F.max(F.when(F.col("c") == columns.index(c), value)).alias(name))
    if by:
        groups = wide.select(*keys).distinct()
        out = groups.join(per.groupBy(*keys).agg(*cells).withColumnsRenamed(dict(zip(keys, side[:-1], strict=True))), _same(keys, side[:-1]), "left")
        out = out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *wanted)
    else:
        out = per.agg(*cells)
    out = stored(out)
    discard(*spent)
    return out


#: Bits of a double that a pass of column_medians() settles.
STEP = 16


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) | np.int64(-(1 << 63)))).view(np.uint64)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column, as exact_quantiles() gives it: nulls and NaN are skipped, None for no values.

    Four passes over df, which should be stored. Each counts the next 16 bits of the values that begin as the searched ones
    do, in numpy: a task holds the counts of all columns (0.5 MB each at most), and the driver sees those of one at a time.
    """
    names = [f"_v{i}" for i in range(len(columns))]
    values = df.select(*[F.col(c).cast("double").alias(v) for c, v in zip(columns, names, strict=True)])
    #: Of each column the searched values' first bits, the place of each among the values that begin so.
    searched: list[dict[int, list[int]]] = [{0: []} for _ in columns]
    total = [0] * len(columns)
    for step in range(64 // STEP):
        shift = np.uint64(64 - STEP * (step + 1))
        heads = [list(s) for s in searched]

        def count(batches: Iterator[pa.RecordBatch], heads=heads, step=step, shift=shift) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for i, asked in enumerate(heads):
                    if not asked:
                        continue
                    x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                    key = _ordered(x[~np.isnan(x)]) >> shift
                    for head in asked:
                        own = key[key >> np.uint64(STEP) == np.uint64(head)] if step else key
                        n = np.bincount((own & np.uint64((1 << STEP) - 1)).astype(np.int64), minlength=1 << STEP)
                        found[i, head] = found[i, head] + n if (i, head) in found else n
            at = {k: np.flatnonzero(n).astype(np.int32) for k, n in found.items()}
            yield pa.RecordBatch.from_pydict({"c": [i for i, _ in found], "head": [str(h) for _, h in found], "at": [at[k].tobytes() for k in found], "n": [n[at[k]].tobytes() for k, n in found.items()]}, schema=counted)

        def add(key, table):
            n = np.zeros(1 << STEP, np.int64)
            for at, m in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
                n[np.frombuffer(at, np.int32)] += np.frombuffer(m, np.int64)
            at = np.flatnonzero(n).astype(np.int32)
            return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "head": [key[1].as_py()], "at": pa.array([at.tobytes()], pa.binary()), "n": pa.array([n[at].tobytes()], pa.binary())})

        counted = pa.schema([("c", pa.int32()), ("head", pa.string()), ("at", pa.binary()), ("n", pa.binary())])
        kind = "c int, head string, at binary, n binary"
        next_: list[dict[int, list[int]]] = [{} for _ in columns]
        for r in values.mapInArrow(count, kind).groupBy("c", "head").applyInArrow(add, kind).toLocalIterator():
            at, upto = np.frombuffer(r["at"], np.int32), np.cumsum(np.frombuffer(r["n"], np.int64))
            head, places = int(r["head"]), searched[r["c"]][int(r["head"])]
            if not step and len(at):
                n = total[r["c"]] = int(upto[-1])
                places = sorted({math.floor((n - 1) / 2), min(math.floor((n - 1) / 2) + 1, n - 1)})
            for place in places:
                j = int(np.searchsorted(upto, place, "right"))
                next_[r["c"]].setdefault((head << STEP) | int(at[j]), []).append(place - (int(upto[j - 1]) if j else 0))
        searched = next_
    out = {}
    for c, n, found in zip(columns, total, searched, strict=True):
        both = sorted(found)
        low, high = (_double(both[0]), _double(both[-1])) if both else (None, None)
        h = (n - 1) / 2
        out[c] = low if low == high else low + (high - low) * (h - math.floor(h))
    return out
