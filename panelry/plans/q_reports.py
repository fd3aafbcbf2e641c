"""Queries of error breakdowns, batch scoring and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelry.operators import grid as g
from panelry.operators import metrics as m
from panelry.operators import scoring as s
from panelry.operators import validate
from panelry.operators.align import dimension, knn_join
from panelry.plans import tables as t
from panelry.plans.q_evaluate import _ROWS, _rows
from panelry.plans.registry import query
from panelry.plans.tables import EDGES, GRID, META, PANEL, rounded

_ERR = f"{_ROWS}, err AS (SELECT *, abs(y - pm25) AS e, y > 100 AS odd FROM r WHERE split = 'test')"


def _errors(spark, sf):
    return _rows(spark, sf).where("split = 'test'").withColumns({"abs_error": F.abs(F.col("y") - F.col("pm25")), "odd": F.col("y") > 100})


def _by_station(spark, sf):
    rate = F.avg(F.col("odd").cast("double"))
    return m.breakdown(_errors(spark, sf), ["station_id"], {"mean_actual": F.avg("y"), "outlier_rate": rate})


_STATION = "bs AS (SELECT station_id, avg(e) AS mae, count(*)::BIGINT AS n, avg(y) AS mean_actual, avg(odd::INT) AS outlier_rate FROM err GROUP BY 1)"


@query("group_agg_station", f"WITH {_ERR}, {_STATION} SELECT station_id, round(mae, 9) AS mae, n, round(mean_actual, 9) AS mean_actual, round(outlier_rate, 9) AS outlier_rate FROM bs")
def group_agg_station(spark, sf):
    return rounded(_by_station(spark, sf))


@query("group_agg_hour", f"WITH {_ERR} SELECT hour(timestamp)::INT AS hour, round(avg(e), 9) AS mae, count(*)::BIGINT AS n FROM err GROUP BY 1")
def group_agg_hour(spark, sf):
    return rounded(m.breakdown(_errors(spark, sf).withColumn("hour", F.hour("timestamp")), ["hour"]))


@query("group_agg_day", f"WITH {_ERR} SELECT strftime(timestamp, '%Y-%m-%d') AS day, round(avg(e), 9) AS mae, count(*)::BIGINT AS n, round(max(y), 9) AS max_actual FROM err GROUP BY 1")
def group_agg_day(spark, sf):
    return rounded(m.breakdown(_errors(spark, sf).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")), ["day"], {"max_actual": F.max("y")}))


@query("group_agg_type", "SELECT r_name, round(avg(s_acctbal), 9) AS mae, count(*)::BIGINT AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_agg_type(spark, sf):
    n = t.source(spark, sf, "nation").join(t.source(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.source(spark, sf, "supplier").join(dimension(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(m.breakdown(joined, ["r_name"], error="s_acctbal"))


@query("top_bottom_k", f"WITH {_ERR}, {_STATION} (SELECT 'worst' AS side, station_id FROM bs ORDER BY round(mae, 9) DESC, station_id LIMIT 5) UNION ALL (SELECT 'best', station_id FROM bs ORDER BY round(mae, 9), station_id LIMIT 5)")
def top_bottom_k(spark, sf):
    b = _by_station(spark, sf).withColumn("mae", F.round("mae", 9))
    worst = m.top_k(b, [F.col("mae").desc(), F.col("station_id")], 5).select(F.lit("worst").alias("side"), "station_id")
    return worst.union(m.top_k(b, [F.col("mae"), F.col("station_id")], 5).select(F.lit("best"), "station_id"))


@query("corr", f"WITH {_ERR}, {_STATION} SELECT round(corr(mae, outlier_rate), 9) AS corr FROM bs")
def corr(spark, sf):
    return rounded(_by_station(spark, sf).agg(F.corr("mae", "outlier_rate").alias("corr")))


@query("abs_error", f"WITH {_ERR} SELECT station_id, timestamp, round(e, 9) AS abs_error, strftime(timestamp, '%Y-%m-%d') AS day, hour(timestamp)::INT AS hour FROM err")
def abs_error(spark, sf):
    return rounded(_errors(spark, sf).select("station_id", "timestamp", "abs_error", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.hour("timestamp").alias("hour")))


@query("station_error_card", f"WITH {_ERR}, {_STATION}, x AS (SELECT station_id, round(mae, 9) AS mae FROM bs) SELECT station_id, mae, row_number() OVER (ORDER BY mae DESC, station_id)::INT AS rank, count(*) OVER ()::BIGINT AS \"of\", row_number() OVER (ORDER BY mae DESC, station_id) <= 10 AS among_worst FROM x")
def station_error_card(spark, sf):
    return s.station_error_card(_by_station(spark, sf).select("station_id", F.round("mae", 9).alias("mae")))


def _requests(spark, sf):
    """One request per event: some without as_of, some for what is not served."""
    return t.events(spark, sf).select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 33 != 0, F.col("station_id") + F.when(F.col("event_id") % 21 == 0, 100000).otherwise(0)).alias("station_id"),
        F.when(F.col("event_id") % 2 == 0, "pm25").when(F.col("event_id") % 5 == 0, "o3").when(F.col("event_id") % 7 != 0, "no2").alias("pollutant"),
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 3 + 1).cast("int")).alias("horizon"),
        F.when(F.col("event_id") % 2 == 0, F.col("timestamp") + F.make_dt_interval(F.lit(0), F.when(F.col("event_id") % 10 == 0, 5000).otherwise(0))).alias("as_of"),
    )


def _served(spark, sf):
    return t.source(spark, sf, "region").where("r_regionkey < 3").select(F.when(F.col("r_regionkey") < 2, "pm25").otherwise("no2").alias("pollutant"), F.when(F.col("r_regionkey") == 1, 2).otherwise(1).alias("horizon"))


_REQ = """req AS (SELECT event_id AS request_id, CASE WHEN event_id % 33 <> 0 THEN station_id + CASE WHEN event_id % 21 = 0 THEN 100000 ELSE 0 END END AS station_id,
 coalesce(CASE WHEN event_id % 2 = 0 THEN 'pm25' WHEN event_id % 5 = 0 THEN 'o3' WHEN event_id % 7 <> 0 THEN 'no2' END, 'pm25') AS pollutant,
 coalesce(CASE WHEN event_id % 4 <> 0 THEN (event_id % 3 + 1)::INT END, 1) AS horizon,
 CASE WHEN event_id % 2 = 0 THEN timestamp + INTERVAL 1 HOUR * CASE WHEN event_id % 10 = 0 THEN 5000 ELSE 0 END END AS as_of FROM ev)"""


@query("request_errors", f"""WITH {PANEL}, {_REQ}, x AS (SELECT req.*, CASE WHEN req.station_id IS NULL THEN 'missing station_id' WHEN pollutant NOT IN ('pm25', 'no2') THEN 'unknown pollutant'
 WHEN horizon NOT IN (1, 2) THEN 'unknown horizon' WHEN req.station_id NOT IN (SELECT station_id FROM panel) THEN 'unknown station' WHEN pollutant = 'no2' AND horizon = 2 THEN 'model unavailable'
 WHEN as_of IS NOT NULL AND p.timestamp IS NULL THEN 'no data at as_of' END AS error FROM req LEFT JOIN panel p ON p.station_id = req.station_id AND p.timestamp = req.as_of)
SELECT request_id, coalesce(station_id, -1) AS station_id, pollutant, horizon, error FROM x WHERE error IS NOT NULL""")
def request_errors(spark, sf):
    return s.request_errors(_requests(spark, sf), t.panel(spark, sf), _served(spark, sf)).withColumn("station_id", F.coalesce("station_id", F.lit(-1)))


def _score(requests, spark, sf):
    floor = lambda c: F.floor(c).cast("double")
    predict = {("pm25", 1): floor("pm25"), ("pm25", 2): floor("pm25"), ("no2", 1): floor("no2")}
    return s.score(requests, t.panel(spark, sf), predict, "v1")


@query("score_as_of", f"""WITH {PANEL}, {_REQ}, l AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1),
x AS (SELECT r.*, l.timestamp, l.pm25, l.no2 FROM req r JOIN l USING (station_id) WHERE as_of IS NULL UNION ALL SELECT r.*, p.timestamp, p.pm25, p.no2 FROM req r JOIN panel p ON p.station_id = r.station_id AND p.timestamp = r.as_of),
v AS (SELECT *, CASE WHEN pollutant = 'pm25' AND horizon IN (1, 2) THEN floor(pm25) WHEN pollutant = 'no2' AND horizon = 1 THEN floor(no2) END AS value FROM x)
SELECT request_id, station_id, pollutant, horizon, timestamp AS as_of, timestamp + INTERVAL 1 HOUR * horizon AS prediction_ts, value::DOUBLE AS value, 'v1' AS model_version, 'µg/m³' AS unit FROM v WHERE value IS NOT NULL""")
def score_as_of(spark, sf):
    return _score(_requests(spark, sf), spark, sf)


@query("score_latest", f"WITH {PANEL} SELECT station_id, timestamp AS as_of, timestamp + INTERVAL 1 HOUR AS prediction_ts, floor(pm25)::DOUBLE AS value FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1")
def score_latest(spark, sf):
    p = t.panel(spark, sf)
    r = p.select("station_id").distinct().select(F.col("station_id").alias("request_id"), "station_id", F.lit(None).cast("string").alias("pollutant"), F.lit(None).cast("int").alias("horizon"), F.lit(None).cast("timestamp_ntz").alias("as_of"))
    return s.score(r, p, {("pm25", 1): F.floor("pm25").cast("double")}, "v1").select("station_id", "as_of", "prediction_ts", "value")


@query("metric_lookup", "WITH n AS (SELECT n_name AS target, n_nationkey AS k FROM nation) SELECT target, CASE WHEN k % 2 = 0 THEN k / 10 WHEN k % 3 = 0 THEN k / 100 END AS r2 FROM n")
def metric_lookup(spark, sf):
    n = t.source(spark, sf, "nation").select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("k"))
    a = n.where("k % 2 = 0").select("target", F.lit("C").alias("tier"), (F.col("k") / 10).alias("r2"))
    b = n.where("k % 3 = 0").select("target", F.lit("boosted").alias("model"), (F.col("k") / 100).alias("r2"))
    return s.metric_lookup(n.select("target"), a, b)


@query("health_summary", f"WITH {PANEL} SELECT count(DISTINCT station_id)::BIGINT AS stations, max(timestamp) AS latest, 3::BIGINT AS models FROM panel")
def health_summary(spark, sf):
    return s.health_summary(t.panel(spark, sf), _served(spark, sf))


@query("neighbor_report", f"WITH {PANEL}, {META}, {EDGES}, l AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1) SELECT e.station_id, rank, neighbor_station_id, round(distance_km, 1) AS distance_km, round(no2, 9) AS value, count(no2) OVER (PARTITION BY e.station_id)::BIGINT AS reporting, count(*) OVER (PARTITION BY e.station_id)::BIGINT AS neighbors FROM edges e LEFT JOIN l ON l.station_id = e.neighbor_station_id")
def neighbor_report(spark, sf):
    latest = g.latest_per_key(t.panel(spark, sf), "station_id", "timestamp")
    return rounded(s.neighbor_report(knn_join(t.meta(spark, sf), "station_id", 5, 100.0), latest, "no2"))


@query("spike_alert", f"WITH {_ROWS}, thr AS (SELECT quantile_cont(y, 0.9) AS threshold FROM r WHERE split = 'train') SELECT station_id, timestamp, coalesce(before >= threshold, false) AS alert, round(before - pm25, 9) AS delta FROM r, thr WHERE split = 'test'")
def spike_alert(spark, sf):
    r = _rows(spark, sf)
    return rounded(s.spike_alert(r.where("split = 'test'"), m.spike_threshold(r.where("split = 'train'"), "y"), "before", "pm25").select("station_id", "timestamp", "alert", "delta"))


@query("station_map", f"WITH {GRID}, n AS (SELECT s_suppkey AS station_id, s_name AS name FROM supplier), x AS (SELECT g.station_id, n.name, pm25, least(pm25 / 30.0, 1.0) AS t FROM grid g LEFT JOIN n USING (station_id) WHERE timestamp = (SELECT max(timestamp) FROM grid)) SELECT station_id, name, round(pm25, 9) AS pm25, CASE WHEN pm25 IS NULL THEN 160 ELSE floor(60 + t * 195)::INT END AS red FROM x")
def station_map(spark, sf):
    names = t.source(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"))
    none = t.source(spark, sf, "region").where("r_regionkey = 0").select(F.lit(None).cast("double").alias("threshold"))
    out = s.station_map(t.grid(spark, sf), names, "pm25", none)
    return rounded(out.select("station_id", "name", "pm25", F.col("color")[0].alias("red")))


@query("station_directory", "SELECT s_suppkey AS station_id, s_name AS name, s_name || ' (' || n_name || ') — id ' || s_suppkey AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def station_directory(spark, sf):
    j = t.source(spark, sf, "supplier").join(dimension(t.source(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("s_suppkey", "station_id")
    return s.station_directory(j, "station_id", "s_name", "n_name")


@query("weather_card", "WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1), w AS (SELECT max(value) FILTER (event_type = 'click') AS a FROM l) SELECT 'temperature' AS label, CASE WHEN floor(a) = 0 THEN '0.0' ELSE floor(a)::DOUBLE::VARCHAR END AS value, '°C' AS unit FROM w UNION ALL SELECT 'wind', 'missing', 'm/s'")
def weather_card(spark, sf):
    e = t.source(spark, sf, "events").where("event_type = 'click'")
    row = e.agg(F.floor(F.max_by("value", F.struct("ts", "event_id"))).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    return s.weather_card(row, {"a": ("temperature", "°C"), "b": ("wind", "m/s")})
