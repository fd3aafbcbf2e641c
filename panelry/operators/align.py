"""Joins that bring several networks onto one station-hour panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelry.functions.scalars import EARTH_KM, haversine

#: Dimension rows that a broadcast is still fit for.
BROADCAST_ROWS = 200_000
#: Columns of a cube's number, the levels of the smallest own cubes (2 ** -2 km) and of those that are wider than the earth
#: (2 ** 14 km), and how many levels down each of the two steps of the nearest search goes.
CELL, LOW_LEVEL, TOP_LEVEL, STEP = ("_x", "_y", "_z"), -2, 14, 4
#: Where cubes start on each axis: one cube of the top level holds the earth, and every cube lies in one of each larger size.
CORNER_KM = 7919.37
#: Bounds of distances (km of chord) are kept apart by more than their rounding.
SLACK_KM = 1e-3
#: Sizes of cubes that the search of k neighbours halves max_km into: 100 km end at 10 cm.
KNN_LEVELS = 20


def dimension(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint for a small side; beyond the limit the shuffle join stands."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _axes(lat: str, lon: str) -> list[Column]:
    """A place on the earth's surface in km from its centre."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [axis * EARTH_KM for axis in (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))]


def _cells(lat: str, lon: str, side: Column | float, shift: Column | float = 0.0) -> list[Column]:
    """Cube numbers of a place on the earth's surface, cubes side km wide.

    A chord is never longer than the arc, so places within side km lie in the same or in touching cubes, across the
    antimeridian and at the poles as anywhere else.
    """
    return [F.floor(axis / side + shift).alias(n) for axis, n in zip(_axes(lat, lon), CELL, strict=True)]


def _around(df: DataFrame) -> DataFrame:
    """Every row 27 times: once for its cube and each that touches it."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for c in CELL:
        df = df.withColumn("_step", F.explode(step)).withColumn(c, F.col(c) + F.col("_step")).drop("_step")
    return df


def nearest_join(points: DataFrame, stations: DataFrame, point_id: str, station_id: str, by: list[str]) -> DataFrame:
    """For each point and parameter the nearest station (ties: smaller id) and its distance in km; none: no row.

    Points carry lat, lon; stations carry lat, lon and the columns of `by`. Null places and parameters meet nobody. Stations
    stand in cubes of several sizes, each twice the one before; the largest holds the earth. The smallest own cube
    of a point with a station in it bounds the distance by its diagonal, less than twice its side, so the nearest one is in
    the cubes around the point one size up. A point far from all stations has large cubes with many of them, so two steps
    go down to cubes of 1/16 and 1/256 of the side and keep those whose box of stations begins no farther than the nearest
    box ends. Of stations at one place only the smallest id can be anyone's nearest. All joins are on cube numbers.
    """
    places = stations.where("lat is not null and lon is not null").groupBy(*by, "lat", "lon").agg(F.min(station_id).alias("_sid"))
    side = lambda level: F.pow(F.lit(2.0), level)
    levels = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_level")
    numbers = lambda df: df.withColumns({c: F.floor((F.col(f"{c}km") + CORNER_KM) / side(F.col("_level"))) for c in CELL})
    axes = lambda lat, lon: {f"{c}km": a for c, a in zip(CELL, _axes(lat, lon), strict=True)}
    p = points.select(F.col(point_id).alias("_pid"), "lat", "lon").where("lat is not null and lon is not null").distinct().withColumns(axes("lat", "lon"))
    s = places.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}).withColumns(axes("_lat", "_lon"))
    settled = numbers(s.select(*by, *axes("_lat", "_lon"), levels(LOW_LEVEL, TOP_LEVEL))).select(*by, "_level", *CELL).distinct()
    place = ["_pid", "lat", "lon", *axes("lat", "lon")]
    first = numbers(p.select("*", levels(LOW_LEVEL, TOP_LEVEL))).join(settled, ["_level", *CELL]).groupBy(*place, *by).agg(F.min("_level").alias("_first"))
    near = _around(numbers(first.withColumn("_level", F.least(F.col("_first") + 1, F.lit(TOP_LEVEL))).drop("_first")))
    # Boxes of the stations of a cube, by the number of the cube that is STEP levels larger.
    low = LOW_LEVEL + 1 - 2 * STEP
    ends = [f(f"{c}km").alias(f"{c}{n}") for c in CELL for n, f in (("low", F.min), ("high", F.max))]
    boxes = numbers(s.select(*by, *axes("_lat", "_lon"), levels(low, TOP_LEVEL - STEP))).groupBy(*by, "_level", *CELL).agg(*ends)
    boxes = boxes.withColumnsRenamed({c: f"{c}in" for c in CELL}).withColumns({c: F.floor(F.col(f"{c}in") / 2**STEP) for c in CELL}).withColumn("_level", F.col("_level") + STEP)
    length = lambda parts: F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])
    begins = length([F.greatest(F.col(f"{c}low") - F.col(f"{c}km"), F.col(f"{c}km") - F.col(f"{c}high"), F.lit(0.0)) for c in CELL])
    reach = length([F.greatest(F.abs(F.col(f"{c}low") - F.col(f"{c}km")), F.abs(F.col(f"{c}high") - F.col(f"{c}km"))) for c in CELL])
    for _ in range(2):
        met = near.join(boxes, [*by, "_level", *CELL]).select(*place, *by, (F.col("_level") - STEP).alias("_level"), *[F.col(f"{c}in").alias(c) for c in CELL], begins.alias("_begins"), reach.alias("_reach"))
        bound = F.min("_reach").over(W.partitionBy("_pid", "lat", "lon", *by))
        near = met.withColumn("_bound", bound).where(F.col("_begins") <= F.col("_bound") + SLACK_KM).drop("_begins", "_reach", "_bound")
    last = numbers(s.select(*by, "_sid", "_lat", "_lon", *axes("_lat", "_lon"), levels(low, TOP_LEVEL - 2 * STEP))).drop(*axes("_lat", "_lon"))
    near = near.join(last, [*by, "_level", *CELL]).withColumn("_d", haversine("lat", "lon", "_lat", "_lon"))
    best = near.groupBy("_pid", *by).agg(F.min(F.struct("_d", "_sid")).alias("_m"))
    return best.select(F.col("_pid").alias(point_id), *by, F.col("_m._sid").alias(station_id), F.col("_m._d").alias("distance_km"))


def knn_candidates(points: DataFrame, key: str, k: int, max_km: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(id0, id, d): for each point some others within max_km, the k nearest among them.

    Points stand in cubes of several sizes, the largest max_km wide, each half the one before. The smallest own cube with
    more than k points bounds the distance of the k-th by its diagonal, so the k nearest are in the cubes around the point
    one size up: in a dense place a point meets a number of others that grows with k, not with the place. Of points at one
    place only the k + 1 smallest ids can be anyone's neighbours.
    """
    base = points.select(F.col(key).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).where("lat is not null and lon is not null")
    first_ids = F.row_number().over(W.partitionBy("lat", "lon").orderBy("id"))
    kept = base.withColumn("_rn", first_ids).where(F.col("_rn") <= k + 1).drop("_rn")
    side = F.pow(F.lit(2.0), F.col("_level") - KNN_LEVELS) * (max_km * 1.000001)
    shift = 0.37 * (KNN_LEVELS - F.col("_level"))
    level = F.explode(F.sequence(F.lit(0), F.lit(KNN_LEVELS))).alias("_level")
    placed = kept.select("*", level).select("*", *_cells("lat", "lon", side, shift))
    crowded = placed.groupBy("_level", *CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k).drop("_n")
    asked = base.withColumnsRenamed({"id": "id0", "lat": "lat0", "lon": "lon0"})
    own = asked.select("*", level).select("*", *_cells("lat0", "lon0", side, shift)).join(crowded, ["_level", *CELL], "left_semi")
    own = own.groupBy("id0", "lat0", "lon0").agg(F.min("_level").alias("_first"))
    # A point without a crowded cube looks as far as max_km.
    up = asked.withColumn("_level", F.lit(KNN_LEVELS)).unionByName(own.select("id0", "lat0", "lon0", F.least(F.col("_first") + 1, F.lit(KNN_LEVELS)).alias("_level")))
    up = up.groupBy("id0", "lat0", "lon0").agg(F.min("_level").alias("_level"))
    near = _around(up.select("*", *_cells("lat0", "lon0", side, shift))).join(placed, ["_level", *CELL]).where("id <> id0")
    return near.select("id0", "id", haversine("lat0", "lon0", "lat", "lon").alias("d")).where(F.col("d") <= max_km)


def knn_join(points: DataFrame, key: str, k: int, max_km: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The k nearest other points within max_km: (key, neighbor_<key>, distance_km, rank). Fewer rows where fewer are near.

    Ties go to the smaller id. Ranks beyond k are cut in each task before the rows are shuffled.
    """
    near = knn_candidates(points, key, k, max_km, lat, lon)
    ranked = near.select("id0", "id", "d", F.row_number().over(W.partitionBy("id0").orderBy("d", "id")).alias("rank")).where(F.col("rank") <= k)
    return ranked.select(F.col("id0").alias(key), F.col("id").alias(f"neighbor_{key}"), F.col("d").alias("distance_km"), "rank")


def collapse_sparse(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Sparse rows of one key become one: each metric's largest value; never measured stays null."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in metrics])


def weather_panel(weather: DataFrame, mapping: DataFrame, metrics: dict[str, list[str]]) -> DataFrame:
    """(station_id, timestamp, metrics): one conditional aggregation in place of a full outer join per parameter.

    mapping: station_id, parameter, dwd_station_id. A parameter fills its own metrics only; rows without time go.
    """
    if not metrics:
        raise ValueError("no parameter has metric columns")
    joined = weather.where(F.col("timestamp").isNotNull()).join(dimension(mapping), ["parameter", "dwd_station_id"])
    cols = [F.max(F.when(F.col("parameter") == p, F.col(c))).alias(c) for p, names in metrics.items() for c in names]
    return joined.where(F.col("parameter").isin(list(metrics))).groupBy("station_id", "timestamp").agg(*cols)


def build_panel(anchor: DataFrame, others: list[DataFrame], meta: DataFrame, keys: list[str]) -> DataFrame:
    """The anchor's rows, all and only those, with the others joined on the keys and the station's coordinates."""
    out = anchor
    for other in others:
        out = out.join(other, keys, "left")
    return out.join(dimension(meta), keys[0], "left")


def inner_common(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keys_df.select(*keys), keys, "left_semi")


def dim_enrich(df: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    return df.join(dimension(dim), key, how)


def align_violations(predictions: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): keys predicted twice, and keys without a prediction. Extra predictions are no problem."""
    twice = predictions.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("problem"))
    none = keys_df.select(*keys).join(predictions, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    return twice.union(none)


def strict_align(predictions: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """The predictions of the keys; running it raises if a key is predicted twice or not at all. Extra ones are ignored.

    The guard is part of the plan, so the predictions are computed once: they are counted by key where the join needs them
    together anyway.
    """
    values = [c for c in predictions.columns if c not in keys]
    per = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    met = keys_df.select(*keys).join(per, keys, "left")
    say = lambda what: F.concat(F.lit(f"predictions do not fit the keys: {what} "), F.to_json(F.struct(*keys)))
    met = met.where(F.assert_true(F.col("_n").isNotNull(), say("missing")).isNull() & F.assert_true(F.col("_n") == 1, say("duplicate")).isNull())
    return met.select(*keys, *values)
