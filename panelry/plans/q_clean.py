"""Queries of filters, cleaning and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelry.operators import clean, validate
from panelry.operators.align import dimension
from panelry.plans import tables as t
from panelry.plans.registry import query
from panelry.plans.tables import EV, GRID, META, PANEL, rounded


@query("filter_window", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def filter_window(spark, sf):
    e = t.source(spark, sf, "events")
    return clean.filter_window(e, "ts", *_ts("2024-01-05", "2024-01-12")).select("event_id", "value")


def _ts(*days):
    import datetime

    return [datetime.datetime.fromisoformat(d) for d in days]


_REPORTING = "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND ts::DATE = DATE '2024-01-10'"


@query("reporting_stations", _REPORTING)
def reporting_stations(spark, sf):
    return clean.reporting_ids(t.source(spark, sf, "events"), "user_id", "ts", "2024-01-10", F.col("event_type") == "click")


@query("semi_join_reporting", f"SELECT event_id FROM events WHERE user_id IN ({_REPORTING})")
def semi_join_reporting(spark, sf):
    return clean.semi_join_reporting(t.source(spark, sf, "events"), reporting_stations(spark, sf), "user_id").select("event_id")


@query("first_n_ids", "SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 7")
def first_n_ids(spark, sf):
    return clean.first_n_ids(t.source(spark, sf, "events"), "user_id", 7)


@query("ids_intersect", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def ids_intersect(spark, sf):
    e = t.source(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("ids_except", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 50")
def ids_except(spark, sf):
    e = t.source(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id").subtract(e.where("event_type = 'error' and value > 50").select("user_id"))


@query("active_filter", "SELECT user_id, max(ts)::DATE::VARCHAR AS bis FROM events GROUP BY user_id HAVING max(ts)::DATE >= DATE '2024-02-28' - INTERVAL 30 DAY")
def active_filter(spark, sf):
    dim = t.source(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("bis"))
    return clean.active_filter(dim, "bis", "2024-02-28").withColumn("bis", F.col("bis").cast("string"))


@query("drop_invalid_ts", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def drop_invalid_ts(spark, sf):
    return clean.drop_invalid_ts(t.source(spark, sf, "lineitem"), "l_shipdate", *_ts("1996-01-01", "1999-12-31")).select("l_orderkey", "l_linenumber")


@query("drop_impossible", "SELECT s_suppkey, s_acctbal FROM (SELECT s_suppkey, nullif(s_acctbal, -999) AS s_acctbal FROM supplier) WHERE s_acctbal IS NULL OR s_acctbal BETWEEN 0 AND 5000")
def drop_impossible(spark, sf):
    from panelry.functions.scalars import sentinel_to_null

    s = t.source(spark, sf, "supplier").select("s_suppkey", sentinel_to_null("s_acctbal").alias("s_acctbal"))
    return clean.drop_impossible(s, "s_acctbal", 0, 5000)


@query("drop_impossible_count", "SELECT count(*) FILTER (s_acctbal IS NOT NULL AND NOT s_acctbal BETWEEN 0 AND 5000)::BIGINT AS dropped FROM supplier")
def drop_impossible_count(spark, sf):
    s = t.source(spark, sf, "supplier")
    return clean.dropped(s, clean.drop_impossible(s, "s_acctbal", 0, 5000))


@query("dedup_first", "SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) = 1")
def dedup_first(spark, sf):
    kept = clean.dedup_first(t.source(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return kept.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")


_BOUNDS = "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query("flag_outliers_iqr", f"WITH {_BOUNDS} SELECT event_id, coalesce(value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1), false) AS is_outlier FROM events, q")
def flag_outliers_iqr(spark, sf):
    return clean.flag_outliers_iqr(t.source(spark, sf, "events"), "value", "is_outlier").select("event_id", "is_outlier")


@query("flag_outliers_by_group", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM events JOIN q USING (event_type)")
def flag_outliers_by_group(spark, sf):
    return clean.flag_outliers_iqr(t.source(spark, sf, "events"), "value", "is_outlier", 1.5, ["event_type"]).select("event_id", "is_outlier")


@query("sentinel_to_null", "SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 7 = 0 THEN -999.0 ELSE o_totalprice END, -999.0) AS price FROM orders")
def sentinel_to_null(spark, sf):
    from panelry.functions.scalars import sentinel_to_null as f

    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(-999.0)).otherwise(F.col("o_totalprice"))
    return t.source(spark, sf, "orders").select("o_orderkey", f(price).alias("price"))


@query("parse_ts_24h", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS ts FROM orders")
def parse_ts_24h(spark, sf):
    from panelry.functions.scalars import parse_ts_24h as f

    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 5 == 0, " 24:00:00").otherwise(" 00:00:00"))
    return t.source(spark, sf, "orders").select("o_orderkey", f(text).alias("ts"))


@query(
    "validate_schema",
    f"""WITH {PANEL}, {META}, p AS (SELECT * FROM panel JOIN meta USING (station_id)),
b AS (SELECT CASE WHEN NOT station_id >= 1 THEN station_id END AS s, CASE WHEN NOT pm25 BETWEEN 0 AND 100 THEN pm25 END AS x, CASE WHEN NOT latitude BETWEEN 50.5 AND 53 THEN latitude END AS l, CASE WHEN NOT no2 <= 90 THEN no2 END AS n FROM p)
SELECT 'station_id' AS column_name, 'not_null' AS check_name, count(*) FILTER (station_id IS NULL)::BIGINT AS failures, NULL::VARCHAR AS lowest, NULL::VARCHAR AS highest FROM p
UNION ALL SELECT 'station_id', 'type(bigint)', 0, NULL, NULL UNION ALL SELECT 'pm25', 'type(double)', 0, NULL, NULL UNION ALL SELECT 'wind', 'required', 1, NULL, NULL
UNION ALL SELECT 'station_id', 'ge(1)', count(s), min(s)::VARCHAR, max(s)::VARCHAR FROM b
UNION ALL SELECT 'pm25', 'in_range(0, 100)', count(x), round(min(x), 6)::VARCHAR, round(max(x), 6)::VARCHAR FROM b
UNION ALL SELECT 'latitude', 'in_range(50.5, 53)', count(l), round(min(l), 6)::VARCHAR, round(max(l), 6)::VARCHAR FROM b
UNION ALL SELECT 'no2', 'le(90)', count(n), round(min(n), 6)::VARCHAR, round(max(n), 6)::VARCHAR FROM b
UNION ALL SELECT '', 'no2_below_pm25', count(*) FILTER (NOT no2 <= pm25), NULL, NULL FROM p
UNION ALL SELECT 'station_id, timestamp', 'unique', 0, NULL, NULL""",
)
def validate_schema(spark, sf):
    p = t.panel(spark, sf).join(dimension(t.meta(spark, sf)), "station_id")
    rules = validate.Rules(
        {"station_id": ("bigint", False, True), "pm25": ("double", True, True), "wind": ("double", True, True)},
        (validate.ge("station_id", 1), validate.in_range("pm25", 0, 100), validate.in_range("latitude", 50.5, 53), validate.le("no2", 90), validate.row_expr("no2_below_pm25", F.col("no2") <= F.col("pm25"))),
        ("station_id", "timestamp"),
    )
    return validate.validate(p, rules)


@query("check_isin", "SELECT 'event_type' AS column_name, 'isin' AS check_name, count(*)::BIGINT AS failures, min(event_type) AS lowest, max(event_type) AS highest FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')")
def check_isin(spark, sf):
    return validate.validate(t.source(spark, sf, "events"), validate.Rules({}, (validate.isin("event_type", ["click", "view", "purchase", "error"]),)))


@query("check_row_expr", "SELECT '' AS column_name, 'one_hour' AS check_name, count(*) FILTER (l_linenumber % 5 = 4)::BIGINT AS failures, NULL::VARCHAR AS lowest, NULL::VARCHAR AS highest FROM lineitem")
def check_row_expr(spark, sf):
    hours = F.when(F.col("l_linenumber") % 5 == 4, 3).otherwise(1)
    rows = t.source(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts_start"), (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), hours)).alias("ts_end"))
    return validate.validate(rows, validate.Rules({}, (validate.row_expr("one_hour", F.col("ts_end") == F.col("ts_start") + F.expr("interval 1 hour")),)))


@query("check_unique", "SELECT l_suppkey, l_shipdate, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(spark, sf):
    return validate.duplicates(t.source(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate"])


@query(
    "quality_report",
    f"""WITH {GRID}, {_BOUNDS.replace("value", "pm25").replace("FROM events", "FROM panel")}
SELECT (SELECT count(*) - count(DISTINCT (station_id, timestamp)) FROM ev)::BIGINT AS duplicates_dropped,
       (SELECT count(*) FILTER (pm25 < q1 - 3 * (q3 - q1) OR pm25 > q3 + 3 * (q3 - q1)) FROM panel, q)::BIGINT AS outliers,
       count(*)::BIGINT AS n_rows, count(DISTINCT station_id)::BIGINT AS stations FROM panel""",
)
def quality_report(spark, sf):
    raw, p = t.events(spark, sf), t.panel(spark, sf)
    flagged = clean.flag_outliers_iqr(p, "pm25", "out")
    one = flagged.agg(F.count_if("out").alias("outliers"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station_id").alias("stations"))
    gone = clean.dropped(raw, raw.select("station_id", "timestamp").distinct(), "duplicates_dropped")
    return one.crossJoin(F.broadcast(gone))


@query("missing_report", f"WITH {GRID} SELECT 'pm25' AS column_name, round(avg((pm25 IS NULL)::INT) * 100, 2) AS pct FROM grid UNION ALL SELECT 'no2', round(avg((no2 IS NULL)::INT) * 100, 2) FROM grid")
def missing_report(spark, sf):
    return validate.missing_percent(t.grid(spark, sf), ["pm25", "no2"])


@query("distinct_count", f"WITH {EV} SELECT count(DISTINCT station_id)::BIGINT AS stations, count(DISTINCT timestamp)::BIGINT AS hours FROM ev")
def distinct_count(spark, sf):
    return rounded(t.events(spark, sf).agg(F.count_distinct("station_id").alias("stations"), F.count_distinct("timestamp").alias("hours")))
