
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry.operators.grid import regularize_grid
from panelry.operators.store import folder, stored  # noqa: F401
from panelry.sources.formats import read_parquet

#: Event types in the roles of weather parameters, with the metric column each fills.
PARAMETERS = {"click": ("air_temperature", "temperature_c"), "view": ("wind", "wind_direction_deg"), "purchase": ("pressure", "pressure_msl_hpa"), "error": ("precipitation", "precipitation_mm")}
METRICS = {p: [c] for p, c in PARAMETERS.values()}


#: Users that share a station. SQL and registered queries take ten; the bench also takes one, for ten times the stations.
USERS_A_STATION = 10


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return source(spark, sf, "events").select("event_id", "ts", "event_type", "value", F.expr(f"user_id div {USERS_A_STATION}").alias("station_id"), hour.alias("timestamp"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    no2 = F.avg(F.when(F.col("event_type").isin("view", "click"), F.col("value")))
    return events(spark, sf).groupBy("station_id", "timestamp").agg(F.avg("value").alias("pm25"), no2.alias("no2"))


def meta(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("station_id")
    lat = F.lit(50.0) + (i * 37 % 199) / 100 + F.when(i % 15 == 7, 4.0).otherwise(0.0)
    return events(spark, sf).select("station_id").distinct().select("station_id", lat.alias("latitude"), (F.lit(9.0) + (i * 53 % 307) / 100).alias("longitude"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Long and sparse: each row fills the metric of its own parameter."""
    kind = F
    for t, (p, _) in PARAMETERS.items():
        kind = kind.when(F.col("event_type") == t, p)
    cols = [F.when(F.col("event_type") == t, F.col("value")).alias(c) for t, (_, c) in PARAMETERS.items()]
    return events(spark, sf).where(F.col("event_type").isin(list(PARAMETERS))).select((F.col("station_id") + 1000).alias("dwd_station_id"), "timestamp", kind.alias("parameter"), *cols)


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.lit(p) for p, _ in PARAMETERS.values()]))
    return events(spark, sf).select("station_id").distinct().select("station_id", kinds.alias("parameter"), (F.col("station_id") + 1000).alias("dwd_station_id"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return regularize_grid(panel(spark, sf), meta(spark, sf))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Floating results at a fixed number of digits, counts as long: what both engines can agree on."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


EV = "ev AS (SELECT user_id // 10 AS station_id, date_trunc('hour', ts) AS timestamp, ts, event_id, event_type, value FROM events)"
PANEL = EV + ", panel AS (SELECT station_id, timestamp, avg(value) AS pm25, avg(value) FILTER (event_type IN ('view', 'click')) AS no2 FROM ev GROUP BY ALL)"
META = "meta AS (SELECT station_id, 50.0::DOUBLE + (station_id * 37 % 199) / 100 + CASE WHEN station_id % 15 = 7 THEN 4.0 ELSE 0.0 END::DOUBLE AS latitude, 9.0::DOUBLE + (station_id * 53 % 307) / 100 AS longitude FROM (SELECT DISTINCT station_id FROM ev))"
HOURS = "hours AS (SELECT unnest(generate_series((SELECT min(timestamp) FROM panel), (SELECT max(timestamp) FROM panel), INTERVAL 1 HOUR)) AS timestamp)"
GRID = f"{PANEL}, {META}, {HOURS}, grid AS (SELECT station_id, timestamp, latitude, longitude, pm25, no2 FROM meta CROSS JOIN hours LEFT JOIN panel USING (station_id, timestamp))"
WEATHER = EV + """, weather AS (SELECT station_id + 1000 AS dwd_station_id, timestamp,
  CASE event_type WHEN 'click' THEN 'air_temperature' WHEN 'view' THEN 'wind' WHEN 'purchase' THEN 'pressure' WHEN 'error' THEN 'precipitation' END AS parameter,
  CASE WHEN event_type = 'click' THEN value END AS temperature_c, CASE WHEN event_type = 'view' THEN value END AS wind_direction_deg,
  CASE WHEN event_type = 'purchase' THEN value END AS pressure_msl_hpa, CASE WHEN event_type = 'error' THEN value END AS precipitation_mm
  FROM ev WHERE event_type IN ('click', 'view', 'purchase', 'error'))"""
DISTANCE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"
EDGES = "pairs AS (SELECT a.station_id, b.station_id AS neighbor_station_id, " + DISTANCE.format(a="a", b="b") + " AS distance_km FROM meta a JOIN meta b ON a.station_id <> b.station_id), edges AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY distance_km, neighbor_station_id)::INT AS rank FROM pairs WHERE distance_km <= 100 QUALIFY rank <= 5)"
SPLIT = "times AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM grid)), ends AS (SELECT max(timestamp) FILTER (i = floor(n * 0.7::DOUBLE)) AS train_end, max(timestamp) FILTER (i = floor(n * (0.7::DOUBLE + 0.15::DOUBLE))) AS val_end FROM times), split AS (SELECT grid.*, CASE WHEN timestamp <= train_end THEN 'train' WHEN timestamp <= val_end THEN 'val' ELSE 'test' END AS split FROM grid, ends)"
