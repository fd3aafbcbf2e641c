"""Regular hourly grid, and everything computed over a station's ordered hours.

All window columns of a station use one window, so a table is exchanged and sorted once for all of them. On the grid every
frame is bounded, so a station's hours are cut into blocks that are windows of their own, with copies of the few hours
around them: a station of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .align import dimension

LAGS, WINDOWS, TREND, PRESSURE = (1, 2, 3, 6, 12, 24), (3, 6, 24), 6, 3
#: Hours of a block, and the hours before and after it that its windows may look at.
BLOCK, BACK, AHEAD = 24 * 28, 24, 24


def panel_bounds(panel: DataFrame, ts: str = "timestamp") -> DataFrame:
    return panel.agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def regularize_grid(panel: DataFrame, meta: DataFrame, bounds: DataFrame | None = None, key: str = "station_id", ts: str = "timestamp", coords: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """Every station of meta at every hour from start to end, stepping from start; the panel joined, coordinates from meta.

    The hours of a station are made where the station is, so the cross product is no join of large sides.
    """
    limits = panel_bounds(panel, ts) if bounds is None else bounds
    stations = meta.select(key, *coords).dropDuplicates([key]).crossJoin(F.broadcast(limits))
    hours = F.explode(F.sequence(F.col("start"), F.col("end"), F.expr("interval 1 hour")))
    grid = stations.select(key, *coords, hours.alias(ts))
    return grid.join(panel.drop(*coords), [key, ts], "left")


def over(key: str = "station_id", ts: str = "timestamp") -> W:
    return W.partitionBy(key).orderBy(ts)


def hour_number(ts: str = "timestamp") -> Column:
    """Hours since 1970 by the clock that the times are written in: no time zone, no daylight saving."""
    return F.date_diff(ts, F.lit("1970-01-01")).cast("long") * 24 + F.hour(ts)


def in_blocks(grid: DataFrame, ts: str = "timestamp", block: int = BLOCK, back: int = BACK, ahead: int = AHEAD) -> DataFrame:
    """Every row in its block (_block, _own true), and once more in each block whose windows look at it.

    grid has one row an hour (see regularize_grid), so that rows and hours are the same distance.
    """
    if block < back + ahead:
        raise ValueError("a block has to be longer than what its windows look at")
    n = hour_number(ts)
    blocks = F.explode(F.sequence(F.floor((n - ahead) / block), F.floor((n + back) / block)))
    return grid.withColumn("_block", blocks).withColumn("_own", F.col("_block") == F.floor(n / block))


def over_block(key: str = "station_id", ts: str = "timestamp") -> W:
    return W.partitionBy(key, "_block").orderBy(ts)


def with_windows(grid: DataFrame, make: Callable[[W], dict[str, Column]], key: str = "station_id", ts: str = "timestamp", block: int = BLOCK, back: int = BACK, ahead: int = AHEAD) -> DataFrame:
    """The grid with the columns that make(window) gives; frames reach at most `back` rows back and `ahead` rows ahead.

    One exchange and one sort by station and block serve all columns, and no task holds more than one block of a station.
    """
    rows = in_blocks(grid, ts, block, back, ahead)
    return rows.withColumns(make(over_block(key, ts))).where("_own").drop("_block", "_own")


def _carried(rows: DataFrame, parts: dict[str, Column], before: Callable[[str], Column], key: str) -> DataFrame:
    """(key, _block, parts): what all earlier blocks of the key hand on; one row a block is ordered, never the hours."""
    each = rows.groupBy(key, "_block").agg(*[c.alias(n) for n, c in parts.items()])
    w = W.partitionBy("_key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumnsRenamed({key: "_key", "_block": "_b"}).select("_key", "_b", *[before(n).over(w).alias(n) for n in parts])


def with_ffill(grid: DataFrame, columns: list[str], key: str = "station_id", ts: str = "timestamp", block: int = BLOCK) -> DataFrame:
    """The last value of each column up to each row, inside its station; each block starts from what came before it."""
    rows = grid.withColumn("_block", F.floor(hour_number(ts) / block))
    last = {f"_l{i}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))) for i, c in enumerate(columns)}
    ahead = _carried(rows, last, lambda n: F.last(n, ignorenulls=True), key)
    w = over_block(key, ts)
    rows = rows.withColumns({c: ffill(c, w) for c in columns})
    rows = rows.join(ahead, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b")), "left")
    return rows.withColumns({c: F.coalesce(c, f"_l{i}") for i, c in enumerate(columns)}).drop("_block", "_key", "_b", *last)


def with_place(grid: DataFrame, name: str = "t_idx", key: str = "station_id", ts: str = "timestamp", block: int = BLOCK) -> DataFrame:
    """The row's place in its station, from 0; each block starts at the number of rows before it."""
    rows = grid.withColumn("_block", F.floor(hour_number(ts) / block))
    ahead = _carried(rows, {"_n": F.count(F.lit(1))}, F.sum, key)
    rows = rows.withColumn(name, F.row_number().over(over_block(key, ts)) - 1)
    rows = rows.join(ahead, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b")), "left")
    return rows.withColumn(name, (F.col(name) + F.coalesce("_n", F.lit(0))).cast("long")).drop("_block", "_key", "_b", "_n")


def lag_features(c: str, w: W, lags: tuple[int, ...] = LAGS) -> dict[str, Column]:
    return {f"{c}_lag_{h}h": F.lag(c, h).over(w) for h in lags}


def rolling_features(c: str, w: W, windows: tuple[int, ...] = WINDOWS) -> dict[str, Column]:
    """Trailing windows that end with the row; nulls are skipped, the deviation needs two values."""
    out = {}
    for name, f in (("rollmean", F.avg), ("rollstd", F.stddev_samp), ("rollmax", F.max), ("rollmin", F.min)):
        out |= {f"{c}_{name}_{n}h": f(c).over(w.rowsBetween(1 - n, 0)) for n in windows}
    return out


def rate_of_change(c: str, w: W) -> dict[str, Column]:
    return {f"{c}_roc_1h": F.col(c) - F.lag(c, 1).over(w)}


def trend(c: str, w: W, hours: int = TREND) -> dict[str, Column]:
    return {f"{c}_trend_{hours}h": (F.col(c) - F.lag(c, hours).over(w)) / hours}


def pollution_features(c: str, w: W, lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS, hours: int = TREND) -> dict[str, Column]:
    return lag_features(c, w, lags) | rolling_features(c, w, windows) | rate_of_change(c, w) | trend(c, w, hours)


def pressure_tendency(c: str, w: W, hours: int = PRESSURE) -> dict[str, Column]:
    return {f"pressure_tendency_{hours}h": F.col(c) - F.lag(c, hours).over(w)}


def targets(c: str, w: W, horizons: tuple[int, ...]) -> dict[str, Column]:
    """The only columns that look ahead."""
    return {f"target_{c}_h{h}": F.lead(c, h).over(w) for h in horizons}


def ffill(c: str, w: W) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def cumcount(w: W) -> Column:
    return F.row_number().over(w) - 1


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    return tail_per_key(df, key, ts, 1)


def tail_per_key(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(ts).desc()))
    return df.withColumn("_rn", place).where(F.col("_rn") <= n).drop("_rn")


def rank_first(df: DataFrame, by: str, tie: str, name: str = "rank") -> DataFrame:
    """Place by falling value, ties by id. One row per key is ranked, never the measurements."""
    return df.withColumn(name, F.row_number().over(W.orderBy(F.col(by).desc(), tie)))


def neighbor_features(values: DataFrame, edges: DataFrame, c: str, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """(key, ts, neighbor_<c>_mean, _count, _roc_1h, nearest_neighbor_distance_km) of stations with neighbours.

    Counts are 0 where all neighbours are silent. values is a regular grid with one row per key and time. Its rows are
    exchanged by time before they meet the edges, not once per edge afterwards: the grouping finds them in place.
    """
    e = edges.select(F.col(key).alias("_to"), F.col(f"neighbor_{key}").alias(key))
    met = values.select(key, ts, c).repartition(ts).join(dimension(e), key)
    mean, count = f"neighbor_{c}_mean", f"neighbor_{c}_count"
    agg = met.groupBy(F.col("_to").alias(key), ts).agg(F.avg(c).alias(mean), F.count(c).alias(count))
    agg = with_windows(agg, lambda w: {f"neighbor_{c}_roc_1h": F.col(mean) - F.lag(mean, 1).over(w)}, key, ts, back=1, ahead=0)
    near = edges.where("rank = 1").select(key, F.col("distance_km").alias("nearest_neighbor_distance_km"))
    return agg.join(dimension(near), key, "left")


def with_neighbor_means(grid: DataFrame, edges: DataFrame, stations: DataFrame, c: str, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """The grid with neighbor_<c>_mean and neighbor_<c>_count; both null for a station without neighbours.

    Each station has an edge to itself here, so that its own row comes out of the same grouping: the grid is exchanged once,
    by time, and joined with nothing but the edges. Columns have to be numbers or booleans.
    """
    links = edges.select(F.col(key).alias("_to"), F.col(f"neighbor_{key}").alias(key), F.lit(False).alias("_mine"))
    links = links.union(stations.select(F.col(key), F.col(key), F.lit(True)).distinct())
    kept = [x for x in grid.columns if x not in (key, ts)]
    met = grid.repartition(ts).join(dimension(links), key)
    value = F.when(~F.col("_mine"), F.col(c))
    made = [F.avg(value).alias("_mean"), F.count(value).alias("_count"), F.count_if(~F.col("_mine")).alias("_near")]
    rows = met.groupBy(F.col("_to").alias(key), ts).agg(F.count_if("_mine").alias("_here"), *[F.max(F.when(F.col("_mine"), F.col(x))).alias(x) for x in kept], *made).where("_here > 0")
    count = F.when(F.col("_near") > 0, F.col("_count"))
    return rows.select(key, ts, *kept, F.col("_mean").alias(f"neighbor_{c}_mean"), count.alias(f"neighbor_{c}_count"))
