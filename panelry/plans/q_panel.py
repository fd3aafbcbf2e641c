"""Queries of joins, the grid, window features, scalars and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelry.functions import scalars
from panelry.operators import align, graph
from panelry.operators import grid as g
from panelry.plans import feature_table
from panelry.plans import tables as t
from panelry.plans.registry import query
from panelry.plans.tables import EDGES, EV, GRID, META, PANEL, WEATHER, rounded

_W = "WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)"


def _edges(spark, sf):
    """Computed once and stored: what reads them counts them first."""
    return t.stored(align.knn_join(t.meta(spark, sf), "station_id", 5, 100.0))


@query("haversine", f"WITH {EV}, {META} SELECT a.station_id, b.station_id AS other, round({t.DISTANCE.format(a='a', b='b')}, 9) AS km FROM meta a JOIN meta b ON b.station_id = a.station_id + 1")
def haversine(spark, sf):
    a, b = t.meta(spark, sf).alias("a"), t.meta(spark, sf).alias("b")
    rows = a.join(b, F.col("b.station_id") == F.col("a.station_id") + 1)
    return rows.select("a.station_id", F.col("b.station_id").alias("other"), F.round(scalars.haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude"), 9).alias("km"))


_SITES = "sites AS (SELECT dwd_station_id, parameter, 50.0::DOUBLE + (dwd_station_id * 29 % 211) / 100 AS latitude, 9.0::DOUBLE + (dwd_station_id * 61 % 293) / 100 AS longitude FROM (SELECT DISTINCT dwd_station_id, parameter FROM weather))"


@query("nearest_join", f"""WITH {WEATHER}, {META}, {_SITES}, d AS (SELECT m.station_id, s.parameter, s.dwd_station_id, {t.DISTANCE.format(a='m', b='s')} AS km FROM meta m, sites s)
SELECT station_id, parameter, dwd_station_id, round(km, 9) AS distance_km FROM d QUALIFY row_number() OVER (PARTITION BY station_id, parameter ORDER BY km, dwd_station_id) = 1""")
def nearest_join(spark, sf):
    i = F.col("dwd_station_id")
    sites = t.weather(spark, sf).select("dwd_station_id", "parameter").distinct().select("*", (F.lit(50.0) + (i * 29 % 211) / 100).alias("lat"), (F.lit(9.0) + (i * 61 % 293) / 100).alias("lon"))
    points = t.meta(spark, sf).select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rounded(align.nearest_join(points, sites, "station_id", "dwd_station_id", ["parameter"]))


@query("knn_join", f"WITH {EV}, {META}, {EDGES} SELECT station_id, neighbor_station_id, round(distance_km, 9) AS distance_km, rank FROM edges")
def knn_join(spark, sf):
    return rounded(_edges(spark, sf))


_METRICS = ["temperature_c", "wind_direction_deg", "pressure_msl_hpa", "precipitation_mm"]
_MAXES = ", ".join(f"max({c}) AS {c}" for c in _METRICS)


@query("collapse_weather", f"WITH {WEATHER} SELECT dwd_station_id, timestamp, {_MAXES} FROM weather GROUP BY ALL")
def collapse_weather(spark, sf):
    return align.collapse_sparse(t.weather(spark, sf), ["dwd_station_id", "timestamp"], _METRICS)


@query("weather_panel", f"WITH {WEATHER} SELECT dwd_station_id - 1000 AS station_id, timestamp, {_MAXES} FROM weather GROUP BY ALL")
def weather_panel(spark, sf):
    return align.weather_panel(t.weather(spark, sf), t.mapping(spark, sf), t.METRICS)


@query("build_panel", f"""WITH {WEATHER}, {META}, w AS (SELECT dwd_station_id - 1000 AS station_id, timestamp, {_MAXES} FROM weather GROUP BY ALL),
a AS (SELECT station_id, timestamp, avg(value) AS pm25 FROM ev GROUP BY ALL), b AS (SELECT station_id, timestamp, avg(value) AS no2 FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL)
SELECT station_id, timestamp, round(pm25, 9) AS pm25, round(no2, 9) AS no2, {", ".join(f"round({c}, 9) AS {c}" for c in _METRICS)}, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude
FROM a LEFT JOIN b USING (station_id, timestamp) LEFT JOIN w USING (station_id, timestamp) LEFT JOIN meta USING (station_id)""")
def build_panel(spark, sf):
    p = t.panel(spark, sf)
    wide = align.weather_panel(t.weather(spark, sf), t.mapping(spark, sf), t.METRICS)
    keys = ["station_id", "timestamp"]
    return rounded(align.build_panel(p.select(*keys, "pm25"), [p.where("no2 is not null").select(*keys, "no2"), wide], t.meta(spark, sf), keys))


@query("dim_enrich", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_enrich(spark, sf):
    s = t.source(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    n = t.source(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return align.dim_enrich(align.dim_enrich(s, n, "n_nationkey"), t.source(spark, sf, "region"), "r_regionkey").select("s_suppkey", "s_name", "n_name", "r_name")


@query("panel_bounds", f"WITH {PANEL} SELECT min(timestamp) AS start, max(timestamp) AS end FROM panel")
def panel_bounds(spark, sf):
    return g.panel_bounds(t.panel(spark, sf))


@query("regularize_grid", f"WITH {GRID} SELECT station_id, timestamp, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, round(pm25, 9) AS pm25, round(no2, 9) AS no2 FROM grid")
def regularize_grid(spark, sf):
    return rounded(t.grid(spark, sf))


def _on_grid(spark, sf, make):
    f = g.with_windows(t.grid(spark, sf), make)
    return rounded(f.select("station_id", "timestamp", *make(g.over_block())))


def _sql(cols: str) -> str:
    return f"WITH {GRID} SELECT station_id, timestamp, {cols} FROM grid {_W}"


_ROLL = [("rollmean", "avg"), ("rollstd", "stddev_samp"), ("rollmax", "max"), ("rollmin", "min")]


def _lags(c: str) -> str:
    return ", ".join(f"round(lag({c}, {h}) OVER w, 9) AS {c}_lag_{h}h" for h in g.LAGS)


def _rolls(c: str) -> str:
    return ", ".join(f"round({f}({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 9) AS {c}_{name}_{n}h" for name, f in _ROLL for n in g.WINDOWS)


_ROC = "round({c} - lag({c}, 1) OVER w, 9) AS {c}_roc_1h"
_TREND = "round(({c} - lag({c}, 6) OVER w) / 6, 9) AS {c}_trend_6h"
_TARGETS = "round(lead(pm25, 1) OVER w, 9) AS target_pm25_h1, round(lead(pm25, 2) OVER w, 9) AS target_pm25_h2"


@query("lag_features", _sql(_lags("pm25")))
def lag_features(spark, sf):
    return _on_grid(spark, sf, lambda w: g.lag_features("pm25", w))


@query("rolling_features", _sql(_rolls("pm25")))
def rolling_features(spark, sf):
    return _on_grid(spark, sf, lambda w: g.rolling_features("pm25", w))


@query("rate_of_change", _sql(_ROC.format(c="pm25")))
def rate_of_change(spark, sf):
    return _on_grid(spark, sf, lambda w: g.rate_of_change("pm25", w))


@query("trend", _sql(_TREND.format(c="pm25")))
def trend(spark, sf):
    return _on_grid(spark, sf, lambda w: g.trend("pm25", w))


@query("pollution_features", _sql(", ".join([_lags("no2"), _rolls("no2"), _ROC.format(c="no2"), _TREND.format(c="no2")])))
def pollution_features(spark, sf):
    return _on_grid(spark, sf, lambda w: g.pollution_features("no2", w))


@query("pressure_tendency", f"WITH {WEATHER}, p AS (SELECT dwd_station_id AS station_id, timestamp, max(pressure_msl_hpa) AS p FROM weather GROUP BY ALL) SELECT station_id, timestamp, round(p - lag(p, 3) OVER w, 9) AS pressure_tendency_3h FROM p {_W}")
def pressure_tendency(spark, sf):
    p = align.collapse_sparse(t.weather(spark, sf), ["dwd_station_id", "timestamp"], ["pressure_msl_hpa"]).withColumnRenamed("dwd_station_id", "station_id")
    return rounded(p.select("station_id", "timestamp", *[c.alias(n) for n, c in g.pressure_tendency("pressure_msl_hpa", g.over()).items()]))


@query("targets", _sql(_TARGETS))
def targets(spark, sf):
    return _on_grid(spark, sf, lambda w: g.targets("pm25", w, (1, 2)))


@query("ffill_group", _sql("round(last_value(pm25 IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS pm25"))
def ffill_group(spark, sf):
    return rounded(g.with_ffill(t.grid(spark, sf), ["pm25"]).select("station_id", "timestamp", "pm25"))


@query("cumcount", _sql("row_number() OVER w - 1 AS t_idx"))
def cumcount(spark, sf):
    return g.with_place(t.grid(spark, sf)).select("station_id", "timestamp", "t_idx")


_NEAR = f"""{GRID}, {EDGES}, n AS (SELECT e.station_id, v.timestamp, avg(v.pm25) AS m, count(v.pm25)::BIGINT AS c FROM edges e JOIN grid v ON v.station_id = e.neighbor_station_id GROUP BY ALL)"""


@query("neighbor_features", f"WITH {_NEAR} SELECT n.station_id, timestamp, round(m, 9) AS neighbor_pm25_mean, c AS neighbor_pm25_count, round(m - lag(m) OVER (PARTITION BY n.station_id ORDER BY timestamp), 9) AS neighbor_pm25_roc_1h, round(e.distance_km, 9) AS nearest_neighbor_distance_km FROM n JOIN edges e ON e.station_id = n.station_id AND e.rank = 1")
def neighbor_features(spark, sf):
    return rounded(g.neighbor_features(t.grid(spark, sf), _edges(spark, sf), "pm25"))


@query("attach_neighbors", f"WITH {_NEAR} SELECT g.station_id, g.timestamp, round(m, 9) AS neighbor_pm25_mean, c::DOUBLE AS neighbor_pm25_count FROM grid g LEFT JOIN n USING (station_id, timestamp)")
def attach_neighbors(spark, sf):
    grid = t.grid(spark, sf)
    near = g.neighbor_features(grid, _edges(spark, sf), "pm25")
    return rounded(grid.select("station_id", "timestamp").join(near, ["station_id", "timestamp"], "left").select("station_id", "timestamp", "neighbor_pm25_mean", F.col("neighbor_pm25_count").cast("double").alias("neighbor_pm25_count")))


@query("build_feature_table", f"""WITH {_NEAR} SELECT g.station_id, g.timestamp, round(pm25, 9) AS pm25, {_lags("pm25")}, {_rolls("no2")}, {_TARGETS}, round(m, 9) AS neighbor_pm25_mean,
 hour(g.timestamp)::INT AS hour, (isodow(g.timestamp) - 1)::INT AS day_of_week FROM grid g LEFT JOIN n USING (station_id, timestamp) WINDOW w AS (PARTITION BY g.station_id ORDER BY g.timestamp)""")
def build_feature_table(spark, sf):
    f = feature_table.build_feature_table(t.stored(t.panel(spark, sf)), t.stored(t.meta(spark, sf)))
    cols = ["pm25", *g.lag_features("pm25", g.over()), *g.rolling_features("no2", g.over()), "target_pm25_h1", "target_pm25_h2", "neighbor_pm25_mean", "hour", "day_of_week"]
    return rounded(f.select("station_id", "timestamp", *cols))


@query("latest_per_key", f"WITH {PANEL} SELECT station_id, timestamp, round(pm25, 9) AS pm25 FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1")
def latest_per_key(spark, sf):
    return rounded(g.latest_per_key(t.panel(spark, sf), "station_id", "timestamp").select("station_id", "timestamp", "pm25"))


@query("tail_n_per_key", f"WITH {PANEL} SELECT station_id, timestamp, round(pm25, 9) AS pm25 FROM panel QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) <= 168")
def tail_n_per_key(spark, sf):
    return rounded(g.tail_per_key(t.panel(spark, sf), "station_id", "timestamp", 168).select("station_id", "timestamp", "pm25"))


@query("rank_first", f"WITH {EV}, s AS (SELECT station_id, round(avg(value), 9) AS mae FROM ev GROUP BY 1) SELECT *, row_number() OVER (ORDER BY mae DESC, station_id)::INT AS rank FROM s")
def rank_first(spark, sf):
    s = t.events(spark, sf).groupBy("station_id").agg(F.round(F.avg("value"), 9).alias("mae"))
    return g.rank_first(s, "mae", "station_id")


_CAL = "hour(d)::INT AS hour, (isodow(d) - 1)::INT AS day_of_week, isodow(d) >= 6 AS is_weekend, month(d)::INT AS month, CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring' WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season"


@query("calendar", f"SELECT event_id, {_CAL.replace('(d)', '(ts)')} FROM events")
def calendar(spark, sf):
    return t.source(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in scalars.calendar("ts").items()])


@query("season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM orders")
def season(spark, sf):
    return t.source(spark, sf, "orders").select("o_orderkey", scalars.season(F.month("o_orderdate")).alias("season"))


@query("cyclical", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) + 0.0 AS hour_cos FROM events")
def cyclical(spark, sf):
    s, c = scalars.cyclical(F.hour("ts"), 24)
    return rounded(t.source(spark, sf, "events").select("event_id", s.alias("hour_sin"), c.alias("hour_cos")))


@query("temporal_features", f"""SELECT event_id, {_CAL.replace('(d)', '(ts)')}, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 9) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * month(ts) / 12), 9) + 0.0 AS month_cos FROM events""")
def temporal_features(spark, sf):
    f = feature_table.with_calendar(t.source(spark, sf, "events"), "ts")
    return rounded(f.select("event_id", "hour", "day_of_week", "is_weekend", "month", "season", "day_of_week_sin", "month_cos"))


@query("wind_components", "SELECT event_id, round(sin(radians(value)), 9) AS wind_direction_sin, round(cos(radians(value)), 9) AS wind_direction_cos FROM events")
def wind_components(spark, sf):
    s, c = scalars.wind_components("value")
    return rounded(t.source(spark, sf, "events").select("event_id", s.alias("wind_direction_sin"), c.alias("wind_direction_cos")))


@query("weather_features", f"WITH {WEATHER}, p AS (SELECT dwd_station_id AS station_id, timestamp, max(pressure_msl_hpa) AS p, max(wind_direction_deg) AS d FROM weather GROUP BY ALL) SELECT station_id, timestamp, round(sin(radians(d)), 9) AS wind_direction_sin, round(p - lag(p, 3) OVER w, 9) AS pressure_tendency_3h FROM p {_W}")
def weather_features(spark, sf):
    p = align.collapse_sparse(t.weather(spark, sf), ["dwd_station_id", "timestamp"], ["pressure_msl_hpa", "wind_direction_deg"]).withColumnRenamed("dwd_station_id", "station_id")
    return rounded(feature_table.with_weather(p).select("station_id", "timestamp", "wind_direction_sin", "pressure_tendency_3h"))


@query("bool_to_float", "SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE (value > 50)::DOUBLE END AS high FROM events")
def bool_to_float(spark, sf):
    high = F.when(F.col("event_type") != "signup", F.col("value") > 50)
    return t.source(spark, sf, "events").select("event_id", scalars.bool_to_double(high).alias("high"))


@query("one_hot_fixed", "SELECT o_orderkey, " + ", ".join(f"coalesce(p = '{v}', false)::DOUBLE AS p_{v}" for v in ("LOW", "HIGH", "NEVER")) + " FROM (SELECT o_orderkey, nullif(split_part(o_orderpriority, '-', 2), 'MEDIUM') AS p FROM orders)")
def one_hot_fixed(spark, sf):
    o = t.source(spark, sf, "orders").select("o_orderkey", F.nullif(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit("MEDIUM")).alias("p"))
    return o.select("o_orderkey", *[c.alias(n) for n, c in scalars.one_hot("p", ["LOW", "HIGH", "NEVER"]).items()])


@query("ts_plus_horizon", "SELECT event_id, ts + INTERVAL 1 HOUR * (1 + event_id % 2) AS prediction_ts FROM events")
def ts_plus_horizon(spark, sf):
    return t.source(spark, sf, "events").select("event_id", scalars.plus_hours("ts", 1 + F.col("event_id") % 2).alias("prediction_ts"))


@query("value_color_scale", """WITH c AS (SELECT event_id, CASE WHEN event_type <> 'signup' THEN value END AS v FROM events), x AS (SELECT *, least(v / 60.0, 1.0) AS t FROM c)
SELECT event_id, CASE WHEN v IS NULL THEN 160 ELSE floor(60 + t * 195)::INT END AS r, CASE WHEN v IS NULL THEN 160 ELSE floor(180 - t * 140)::INT END AS g FROM x""")
def value_color_scale(spark, sf):
    c = scalars.color_scale(F.when(F.col("event_type") != "signup", F.col("value")), F.lit(60.0))
    return t.source(spark, sf, "events").select("event_id", c[0].alias("r"), c[1].alias("g"))


@query("edge_symmetrize", f"WITH {EV}, {META}, {EDGES}, p AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS pos FROM meta), b AS (SELECT station_id AS s, neighbor_station_id AS t FROM edges UNION SELECT neighbor_station_id, station_id FROM edges) SELECT x.pos AS source_pos, y.pos AS target_pos FROM b JOIN p x ON x.station_id = s JOIN p y ON y.station_id = t")
def edge_symmetrize(spark, sf):
    return graph.edge_symmetrize(_edges(spark, sf), t.meta(spark, sf))


@query("replicate_graph", f"WITH {GRID}, {EDGES} SELECT h.timestamp, e.station_id, e.neighbor_station_id FROM (SELECT DISTINCT timestamp FROM panel) h, edges e")
def replicate_graph(spark, sf):
    return graph.replicate_graph(_edges(spark, sf).select("station_id", "neighbor_station_id"), t.panel(spark, sf))


@query("graph_snapshots", f"WITH {PANEL}, m AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS pos FROM (SELECT DISTINCT station_id FROM ev)), h AS (SELECT DISTINCT timestamp FROM panel) SELECT h.timestamp, pos // 8 AS tile, pos, round(pm25, 9) AS pm25, round(no2, 9) AS no2 FROM h CROSS JOIN m LEFT JOIN panel p ON p.station_id = m.station_id AND p.timestamp = h.timestamp")
def graph_snapshots(spark, sf):
    """Every node of every snapshot, out of tiles of eight stations."""
    s = graph.graph_snapshots(t.panel(spark, sf), t.meta(spark, sf), ["pm25", "no2"], tile=8)
    n = s.select("timestamp", "tile", F.inline("nodes"))
    return rounded(n.select("timestamp", "tile", "pos", F.get("features", F.lit(0)).alias("pm25"), F.get("features", F.lit(1)).alias("no2")))


_BOTH = "b AS (SELECT station_id AS s, neighbor_station_id AS t FROM edges UNION SELECT neighbor_station_id, station_id FROM edges)"


@query("flagship", f"""WITH {GRID}, {t.SPLIT}, f AS (SELECT *, lead(pm25) OVER (PARTITION BY station_id ORDER BY timestamp) AS y FROM split), r AS (SELECT split, y, pm25 AS p FROM f WHERE y IS NOT NULL AND pm25 IS NOT NULL)
SELECT split, count(*)::BIGINT AS n, round(avg(abs(y - p)), 9) AS mae, round(sqrt(avg((y - p) * (y - p))), 9) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS r2,
       round(avg(CASE WHEN abs(y) >= 1 THEN abs((y - p) / y) END) * 100, 9) AS mape_pct, count(*) FILTER (NOT abs(y) >= 1)::BIGINT AS mape_excluded FROM r GROUP BY split""")
def flagship(spark, sf):
    """Events to a scored forecast: panel, grid, features, target, split, persistence, metrics."""
    from panelry.operators.metrics import regression_metrics
    from panelry.operators.models import persistence
    from panelry.operators.split import chronological_split

    f = feature_table.build_feature_table(t.stored(t.panel(spark, sf)), t.stored(t.meta(spark, sf)))
    rows = persistence(chronological_split(f), "pm25").na.drop(subset=["target_pm25_h1", "pm25"])
    return rounded(regression_metrics(rows, "target_pm25_h1", "prediction", ["split"]))


