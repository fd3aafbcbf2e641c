"""Queries of sources and sinks: text made from the tables is parsed back, so the plain table is the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelry.operators.config import FeatureConfig
from panelry.plans import tables as t
from panelry.plans.registry import query
from panelry.sources import formats


@query("src_parquet", "SELECT event_id, ts, user_id, event_type, value FROM events")
def src_parquet(spark, sf):
    return t.source(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("src_measures_json", "SELECT user_id AS station_id, event_id % 7 AS component_id, 2::BIGINT AS scope_id, CASE WHEN event_type <> 'signup' THEN value END AS value, ts_start, ts_start + INTERVAL 1 HOUR AS ts_end FROM (SELECT *, date_trunc('hour', ts) AS ts_start FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) = 1)")
def src_measures_json(spark, sf):
    e = t.source(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    first = e.groupBy("user_id", "h").agg(F.min(F.struct("event_id", "event_type", "value")).alias("m"))
    end = F.col("h") + F.expr("interval 1 hour")
    midnight = F.hour(end) == 0
    text = F.when(midnight, F.concat(F.date_format("h", "yyyy-MM-dd"), F.lit(" 24:00:00"))).otherwise(F.date_format(end, "yyyy-MM-dd HH:mm:ss"))
    cells = F.array((F.col("m.event_id") % 7).cast("string"), F.lit("2"), F.when(F.col("m.event_type") != "signup", F.col("m.value").cast("string")), text, F.lit("1"))
    rows = first.select("user_id", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("start"), cells.alias("cells"))
    hours = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("start", "cells"))).alias("hours"))
    payload = hours.select(F.to_json(F.create_map(F.col("user_id").cast("string"), "hours"), {"ignoreNullFields": "false"}).alias("payload"))
    return formats.parse_measures(payload).select("station_id", "component_id", "scope_id", "value", "ts_start", "ts_end")


@query("src_station_json", "SELECT s_suppkey AS station_id, s_name AS station_name, s_acctbal AS latitude, CASE WHEN s_suppkey % 3 > 0 THEN TIMESTAMP '2020-01-02' END AS active_from FROM supplier")
def src_station_json(spark, sf):
    s = t.source(spark, sf, "supplier")
    cells = {0: F.col("s_suppkey").cast("string"), 2: F.col("s_name"), 5: F.when(F.col("s_suppkey") % 3 > 0, "2020-01-02").otherwise("unknown"), 8: F.col("s_acctbal").cast("string")}
    rows = s.select(F.create_map(F.col("s_suppkey").cast("string"), F.array(*[cells.get(i, F.lit("")) for i in range(20)])).alias("m"))
    return formats.parse_stations(rows.select(F.to_json("m").alias("payload"))).select("station_id", "station_name", "latitude", "active_from")


@query("src_station_fwf", "SELECT s_suppkey AS station_id, '1999-12-31' AS von_datum, s_name AS station_name, s_acctbal AS latitude FROM supplier")
def src_station_fwf(spark, sf):
    s = t.source(spark, sf, "supplier")
    pad = lambda c, n: F.rpad(c, n, " ")
    line = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(" 19991231 20240101 "), F.lpad(F.lit("12"), 14, " "), F.lit(" "), F.lpad(F.format_string("%.2f", "s_acctbal"), 10, " "), F.lit(" "), F.lpad(F.lit("9.5"), 9, " "), F.lit("  "), pad(F.col("s_name"), 40), F.lit(" "), pad(F.lit("Land"), 40))
    lines = s.select(line.alias("line"))
    extra = t.source(spark, sf, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Stations_id von_datum").otherwise("").alias("line"))
    path = t.folder(spark)
    lines.union(extra).write.text(path)
    return formats.read_fixed_width(spark, path).select("station_id", F.col("von_datum").cast("string").alias("von_datum"), "station_name", "latitude")


@query("src_weather_csv", "SELECT o_custkey AS dwd_station_id, o_orderdate AS timestamp, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS pressure_msl_hpa FROM orders")
def src_weather_csv(spark, sf):
    price = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice").cast("string")).otherwise("  -999")
    raw = t.source(spark, sf, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 11, " ").alias("STATIONS_ID"), F.date_format("o_orderdate", "yyyyMMddHH").alias("MESS_DATUM"), F.lit(" 5").alias("P0"), price.alias("P"))
    path = t.folder(spark)
    raw.write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False)
    return formats.read_weather_text(spark, path, "pressure").drop("parameter")


@query("union_sources", "SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS price FROM supplier UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union_sources(spark, sf):
    a = t.source(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = t.source(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return formats.union_sources([a, b])


@query("ingest_manifest", "SELECT 'events' AS source, count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_keys, min(ts) AS first_ts, max(ts) AS last_ts FROM events UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), min(o_orderdate), max(o_orderdate) FROM orders")
def ingest_manifest(spark, sf):
    return formats.manifest({"events": (t.source(spark, sf, "events"), "user_id", "ts"), "orders": (t.source(spark, sf, "orders"), "o_custkey", "o_orderdate")})


@query("sink_json_report", "SELECT '{\"event_type\":\"' || event_type || '\",\"n\":' || count(*) || '}' AS report FROM events GROUP BY event_type")
def sink_json_report(spark, sf):
    return formats.json_report(t.source(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@query("sink_parquet", "SELECT event_id, user_id, event_type, value, ts FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) UNION ALL SELECT event_id, user_id, event_type, -value, ts FROM events WHERE ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events)")
def sink_parquet(spark, sf):
    """Events by day; then the first day is written again with other values, and no other day with it."""
    path = t.folder(spark)
    columns = ["event_id", "user_id", "event_type", "value", "ts"]
    rows = t.source(spark, sf, "events").select(*columns, F.to_date("ts").alias("day"))
    formats.write_by_day(rows, path, "day")
    first = rows.join(F.broadcast(rows.agg(F.min("day").alias("first"))), F.col("day") == F.col("first")).drop("first")
    formats.write_by_day(first.withColumn("value", -F.col("value")), path, "day")
    return formats.read_parquet(spark, path).select(columns)


_RESULTS = "SELECT event_type AS model, count(*)::BIGINT AS n, round(avg(value), 9) AS mae, NULL::DOUBLE AS r2 FROM events GROUP BY 1"


def _results(spark, sf) -> str:
    """A results file in the shape of the evaluation's: one row per model, a metric that is not known left empty."""
    path = t.folder(spark)
    rows = t.source(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mae"), F.lit(None).cast("double").alias("r2"))
    formats.write_csv(t.rounded(rows), path)
    return path


@query("sink_csv_results", _RESULTS)
def sink_csv_results(spark, sf):
    return t.rounded(formats.read_csv(spark, _results(spark, sf), "model string, n long, mae double, r2 double"))


@query("src_csv_results", f"SELECT model, n, mae FROM ({_RESULTS})")
def src_csv_results(spark, sf):
    """Two results files of which one was never written."""
    kind = "model string, n long, mae double, r2 double"
    found = [formats.read_csv(spark, path, kind) for path in (_results(spark, sf), t.folder(spark))]
    return t.rounded(formats.union_sources(found).select("model", "n", "mae"))


#: The numbers that features are made with.
_CONFIG = {"lags": "1,2,3,6,12,24", "windows": "3,6,24", "trend": "6", "pressure": "3", "neighbors": "5", "max_km": "100.0", "horizons.pm25": "1,2", "horizons.no2": "1", "block": "672"}


@query("src_yaml_config", f"SELECT name, value, n_rows FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _CONFIG.items())}) x(name, value), (SELECT count(*)::BIGINT AS n_rows FROM events)")
def src_yaml_config(spark, sf):
    """The configuration that build_feature_table() works with, beside the size of what it is applied to."""
    n = t.source(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_rows"))
    return FeatureConfig().table(spark).crossJoin(F.broadcast(n))
