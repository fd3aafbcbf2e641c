"""Batch scoring of request rows and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry.functions.scalars import color_scale, plus_hours

from .align import dimension
from .grid import latest_per_key, rank_first


def with_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"pollutant": F.coalesce("pollutant", F.lit("pm25")), "horizon": F.coalesce("horizon", F.lit(1))})


def request_errors(requests: DataFrame, features: DataFrame, served: DataFrame, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Requests that cannot be served, each with its first reason. served: (pollutant, horizon)."""
    r = with_defaults(requests)
    known = features.select(F.col(key).alias("_known")).distinct()
    at = features.select(F.col(key).alias("_k"), F.col(ts).alias("_t")).distinct()
    model = served.select(F.col("pollutant").alias("_p"), F.col("horizon").alias("_h"))
    j = r.join(known, r[key] == F.col("_known"), "left").join(at, (r[key] == F.col("_k")) & (r["as_of"] == F.col("_t")), "left").join(dimension(model), (r["pollutant"] == F.col("_p")) & (r["horizon"] == F.col("_h")), "left")
    error = (
        F.when(F.col(key).isNull(), "missing station_id")
        .when(~F.col("pollutant").isin("pm25", "no2"), "unknown pollutant")
        .when(~F.col("horizon").isin(1, 2), "unknown horizon")
        .when(F.col("_known").isNull(), "unknown station")
        .when(F.col("_p").isNull(), "model unavailable")
        .when(F.col("as_of").isNotNull() & F.col("_t").isNull(), "no data at as_of")
    )
    return j.withColumn("error", error).where(F.col("error").isNotNull()).select("request_id", key, "pollutant", "horizon", "error")


def rows_for(requests: DataFrame, features: DataFrame, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Each request with its feature row: the latest of the station, or exactly as_of."""
    r = with_defaults(requests)
    latest = latest_per_key(features, key, ts).withColumn("_latest", F.lit(True))
    now = r.where(F.col("as_of").isNull()).join(latest.drop("_latest"), key)
    then = r.where(F.col("as_of").isNotNull()).join(features, key).where(F.col("as_of") == F.col(ts))
    return now.unionByName(then)


def score(requests: DataFrame, features: DataFrame, predict: dict[tuple[str, int], Column], version: str, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """as_of, prediction_ts, value (two decimals), model version and unit of each servable request."""
    rows = rows_for(requests, features, key, ts)
    value = F
    for (pollutant, horizon), c in predict.items():
        value = value.when((F.col("pollutant") == pollutant) & (F.col("horizon") == horizon), c)
    out = rows.withColumn("value", F.round(value, 2)).where(F.col("value").isNotNull())
    return out.select("request_id", key, "pollutant", "horizon", F.col(ts).alias("as_of"), plus_hours(ts, "horizon").alias("prediction_ts"), "value", F.lit(version).alias("model_version"), F.lit("µg/m³").alias("unit"))


def metric_lookup(requested: DataFrame, ablation: DataFrame, baselines: DataFrame) -> DataFrame:
    """Test r2 of the served model: tier C of the ablation, else the boosted row of the baselines."""
    a = ablation.where("tier = 'C'").select("target", F.col("r2").alias("_a"))
    b = baselines.where("model = 'boosted'").select("target", F.col("r2").alias("_b"))
    return requested.join(dimension(a), "target", "left").join(dimension(b), "target", "left").select("target", F.coalesce("_a", "_b").alias("r2"))


def health_summary(features: DataFrame, served: DataFrame, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    one = features.agg(F.count_distinct(key).alias("stations"), F.max(ts).alias("latest"))
    return one.crossJoin(F.broadcast(served.agg(F.count(F.lit(1)).alias("models"))))


def neighbor_report(edges: DataFrame, latest: DataFrame, c: str, key: str = "station_id") -> DataFrame:
    """Neighbours by rank with their latest value; how many of them report."""
    now = latest.select(F.col(key).alias(f"neighbor_{key}"), F.col(c).alias("value"))
    rows = edges.join(now, f"neighbor_{key}", "left")
    counts = rows.groupBy(key).agg(F.count("value").alias("reporting"), F.count(F.lit(1)).alias("neighbors"))
    return rows.join(counts, key).select(key, "rank", f"neighbor_{key}", F.round("distance_km", 1).alias("distance_km"), "value", "reporting", "neighbors")


def spike_alert(scored: DataFrame, threshold: DataFrame, prediction: str, current: str) -> DataFrame:
    return scored.crossJoin(F.broadcast(threshold)).withColumns({"alert": F.coalesce(F.col(prediction) >= F.col("threshold"), F.lit(False)), "delta": F.col(prediction) - F.col(current)}).drop("threshold")


def station_map(features: DataFrame, names: DataFrame, c: str, ceiling: DataFrame, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Rows of the last hour with names and colours; ceiling: one row, threshold (null: 15)."""
    last = features.agg(F.max(ts).alias("_last"))
    now = features.crossJoin(F.broadcast(last)).where(F.col(ts) == F.col("_last"))
    top = ceiling.select((2 * F.coalesce("threshold", F.lit(15.0))).alias("_top"))
    return now.crossJoin(F.broadcast(top)).join(dimension(names), key, "left").withColumn("color", color_scale(c, "_top"))


def station_directory(names: DataFrame, key: str, name: str, city: str) -> DataFrame:
    label = F.format_string("%s (%s) — id %d", F.col(name), F.col(city), F.col(key))
    return names.select(key, F.col(name).alias("name"), label.alias("label")).orderBy("name", key)


def weather_card(row: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, value, unit) rows; a null value reads 'missing'."""
    cells = [F.struct(F.lit(label).alias("label"), F.coalesce(F.round(c, 1).cast("string"), F.lit("missing")).alias("value"), F.lit(unit).alias("unit")) for c, (label, unit) in metrics.items()]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def station_error_card(by_station: DataFrame, key: str = "station_id", worst: int = 10) -> DataFrame:
    """Each station's place among all by error, and whether it is one of the worst."""
    total = by_station.agg(F.count(F.lit(1)).alias("of"))
    return rank_first(by_station, "mae", key).crossJoin(F.broadcast(total)).withColumn("among_worst", F.col("rank") <= worst)
