"""Queries of splits, guards, matrices, preparation, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelry.functions.scalars import calendar
from panelry.operators import align, clean, graph, models, prepare, split, validate
from panelry.operators import grid as g
from panelry.operators import metrics as m
from panelry.operators.quantiles import exact_quantiles
from panelry.plans import tables as t
from panelry.plans.feature_table import build_feature_table
from panelry.plans.registry import query
from panelry.plans.tables import GRID, PANEL, SPLIT, rounded

_ROWS = f"{GRID}, {SPLIT}, f AS (SELECT *, lead(pm25) OVER w AS y, lag(pm25) OVER w AS before, lead(timestamp) OVER w AS y_ts FROM split WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)), r AS (SELECT * FROM f WHERE y IS NOT NULL AND pm25 IS NOT NULL)"


def _features(spark, sf):
    w = g.over()
    f = split.chronological_split(t.grid(spark, sf))
    return f.withColumns({"y": F.lead("pm25", 1).over(w), "before": F.lag("pm25", 1).over(w), "y_ts": F.lead("timestamp", 1).over(w)})


def _rows(spark, sf):
    return _features(spark, sf).na.drop(subset=["y", "pm25"])


@query("chronological_split", f"WITH {GRID}, {SPLIT} SELECT station_id, timestamp, split FROM split")
def chronological_split(spark, sf):
    return split.chronological_split(t.grid(spark, sf)).select("station_id", "timestamp", "split")


@query("split_by_index", "WITH d AS (SELECT DISTINCT o_orderdate AS d FROM orders), i AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM d) SELECT d, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM i")
def split_by_index(spark, sf):
    days = t.source(spark, sf, "orders").select(F.col("o_orderdate").alias("d")).distinct()
    return split.chronological_split(days, "d", 0.6, 0.2).select("d", "split")


@query("split_periods", f"WITH {GRID}, {SPLIT} SELECT split, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*)::BIGINT AS n FROM split GROUP BY split")
def split_periods(spark, sf):
    return split.split_periods(split.chronological_split(t.grid(spark, sf)), "timestamp")


@query("assert_chronological", "SELECT split, min(o_orderdate) AS first_ts FROM (SELECT o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders) GROUP BY split HAVING split <> 'test'")
def assert_chronological(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    o = t.source(spark, sf, "orders").withColumn("split", label)
    p = split.split_periods(o, "o_orderdate")
    return split.chronology_violations(p).join(p.select("split", "first_ts"), "split").select("split", "first_ts")


@query("assert_feature_time", "SELECT event_id FROM events WHERE ts > date_trunc('hour', ts) + INTERVAL 30 MINUTE")
def assert_feature_time(spark, sf):
    e = t.source(spark, sf, "events").withColumn("p", F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("interval 30 minutes"))
    return split.feature_time_violations(e, "ts", "p").select("event_id")


@query("assert_target_offset", f"WITH {PANEL}, f AS (SELECT *, lead(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp) AS y_ts FROM panel) SELECT station_id, timestamp FROM f WHERE y_ts <> timestamp + INTERVAL 1 HOUR")
def assert_target_offset(spark, sf):
    p = t.panel(spark, sf)
    p = p.withColumn("y_ts", F.lead("timestamp", 1).over(g.over()))
    return split.target_offset_violations(p, "y_ts", "timestamp", 1).select("station_id", "timestamp")


_PRINTED = """WITH r AS (SELECT md5(o_custkey || chr(10) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') || chr(10) || o_orderkey || chr(10) || o_orderpriority || chr(10) || o_orderstatus || chr(10)
 || floor(o_totalprice)::BIGINT || '+' || floor((o_totalprice - floor(o_totalprice)) * 4503599627370496.0::DOUBLE)::BIGINT || chr(10)) AS h FROM orders),
s AS (SELECT count(*) AS n, sum(('0x' || left(h, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS a, sum(('0x' || right(h, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS b FROM r)
SELECT left(md5('o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice|' || n || '|' || a || '|' || b), 12) AS fingerprint FROM s"""


@query("dataset_fingerprint", _PRINTED)
def dataset_fingerprint(spark, sf):
    return split.fingerprint(t.source(spark, sf, "orders"))


@query("feature_columns", "SELECT * FROM (VALUES ('pm25'), ('no2'), ('latitude'), ('longitude')) x(name), (SELECT count(*)::BIGINT AS n_rows FROM events)")
def feature_columns(spark, sf):
    grid = t.grid(spark, sf).withColumns(g.targets("pm25", g.over(), (1,)))
    names = F.explode(F.array(*[F.lit(c) for c in split.feature_columns(grid)]))
    return t.source(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", names.alias("name"))


_SEASONS = ", ".join(f"coalesce(season = '{s}', false)::DOUBLE AS season_{s}" for s in ("winter", "spring", "summer", "autumn"))


@query("feature_matrix", f"WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season, isodow(o_orderdate) >= 6 AS is_weekend FROM orders) SELECT o_orderkey, o_totalprice, is_weekend::DOUBLE AS is_weekend, {_SEASONS} FROM o")
def feature_matrix(spark, sf):
    c = calendar("o_orderdate")
    o = t.source(spark, sf, "orders").withColumns({"season": c["season"], "is_weekend": c["is_weekend"]})
    return split.feature_matrix(o, ["o_totalprice", "is_weekend", "season"], ["o_orderkey"])


@query("dropna_subset", f"WITH {GRID} SELECT station_id, timestamp FROM grid WHERE pm25 IS NOT NULL AND no2 IS NOT NULL")
def dropna_subset(spark, sf):
    return split.dropna_subset(t.grid(spark, sf), ["pm25", "no2"]).select("station_id", "timestamp")


@query("select_common_rows", f"WITH {_ROWS} SELECT station_id, timestamp FROM r WHERE split = 'test'")
def select_common_rows(spark, sf):
    return split.select_common_rows(_features(spark, sf).where("split = 'test'"), ["y", "pm25"], ["station_id", "timestamp"])


@query("inner_common", f"WITH {_ROWS} SELECT station_id, timestamp, round(pm25, 9) AS pm25 FROM panel SEMI JOIN (SELECT station_id, timestamp FROM r WHERE split = 'test') USING (station_id, timestamp)")
def inner_common(spark, sf):
    from panelry.operators.align import inner_common as f

    return rounded(f(t.panel(spark, sf).select("station_id", "timestamp", "pm25"), select_common_rows(spark, sf), ["station_id", "timestamp"]))


@query("strict_align", f"WITH {GRID} SELECT station_id, timestamp, 'missing' AS problem FROM grid WHERE no2 IS NULL AND pm25 IS NOT NULL")
def strict_align(spark, sf):
    from panelry.operators.align import align_violations

    p = t.panel(spark, sf)
    return align_violations(p.where("no2 is not null"), p, ["station_id", "timestamp"])


@query("impute_median_train", f"WITH {GRID}, {SPLIT}, md AS (SELECT median(pm25) AS a, median(no2) AS b FROM split WHERE split = 'train') SELECT station_id, timestamp, round(coalesce(pm25, a), 9) AS pm25, round(coalesce(no2, b), 9) AS no2 FROM split, md")
def impute_median_train(spark, sf):
    s = split.chronological_split(t.grid(spark, sf))
    return rounded(prepare.impute_median(s, s.where("split = 'train'"), ["pm25", "no2"]).select("station_id", "timestamp", "pm25", "no2"))


@query("median_columns", f"WITH {GRID} SELECT round(median(pm25), 9) AS pm25, round(median(no2), 9) AS no2, 0.0::DOUBLE AS never FROM grid")
def median_columns(spark, sf):
    grid = t.grid(spark, sf).withColumn("never", F.lit(None).cast("double"))
    one = prepare.medians(grid, ["pm25", "no2", "never"], 0.0)
    return rounded(one.toDF("pm25", "no2", "never"))


@query("missing_mask", f"WITH {GRID} SELECT station_id, timestamp, (pm25 IS NULL)::INT::DOUBLE AS pm25_was_missing FROM grid")
def missing_mask(spark, sf):
    return prepare.missing_mask(t.grid(spark, sf), ["pm25"]).select("station_id", "timestamp", "pm25_was_missing")


@query("station_arrays", f"WITH {GRID}, md AS (SELECT median(pm25) AS a FROM grid) SELECT station_id, timestamp, (pm25 IS NULL)::INT::DOUBLE AS pm25_was_missing, round(coalesce(last_value(pm25 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a), 9) AS pm25 FROM grid, md")
def station_arrays(spark, sf):
    return rounded(prepare.station_arrays(t.grid(spark, sf), ["pm25"], ["pm25"]).select("station_id", "timestamp", "pm25", "pm25_was_missing"))


_IDX = f"{GRID}, i AS (SELECT *, row_number() OVER w - 1 AS t_idx, lead(pm25) OVER w AS y FROM grid WINDOW w AS (PARTITION BY station_id ORDER BY timestamp))"


@query("sequence_samples", f"WITH {_IDX} SELECT station_id, timestamp, t_idx FROM i WHERE t_idx >= 23 AND y IS NOT NULL")
def sequence_samples(spark, sf):
    grid = t.grid(spark, sf).withColumn("y", F.lead("pm25", 1).over(g.over()))
    return prepare.sequence_samples(grid, 24, ["y"]).select("station_id", "timestamp", "t_idx")


_STATS = "st AS (SELECT avg(pm25) AS mean, CASE WHEN stddev_pop(pm25) > 1e-6 THEN stddev_pop(pm25) ELSE 1 END AS std FROM split WHERE split = 'train')"


@query("mean_std_pop", f"WITH {GRID}, {SPLIT}, {_STATS} SELECT round(mean, 9) AS mean, round(std, 9) AS std FROM st")
def mean_std_pop(spark, sf):
    s = split.chronological_split(t.grid(spark, sf)).where("split = 'train'")
    return rounded(prepare.norm_stats(s, ["pm25"]).toDF("mean", "std"))


@query("normalize_train", f"WITH {GRID}, {SPLIT}, {_STATS} SELECT station_id, timestamp, round((pm25 - mean) / std, 9) AS pm25 FROM split, st")
def normalize_train(spark, sf):
    s = split.chronological_split(t.grid(spark, sf))
    return rounded(prepare.normalize(s, s.where("split = 'train'"), ["pm25"]).select("station_id", "timestamp", "pm25"))


@query("target_norm", f"WITH {_ROWS}, st AS (SELECT avg(y) AS mean, stddev_pop(y) AS std FROM r WHERE split = 'train') SELECT station_id, timestamp, round(0.5 * std + mean, 9) AS p FROM r, st")
def target_norm(spark, sf):
    r = _rows(spark, sf)
    return rounded(prepare.denormalize(r.withColumn("p", F.lit(0.5)), r.where("split = 'train'"), "p", "y").select("station_id", "timestamp", "p"))


_METRICS = "count(*)::BIGINT AS n, round(avg(abs(y - p)), 9) AS mae, round(sqrt(avg((y - p) * (y - p))), 9) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS r2, round(avg(CASE WHEN abs(y) >= 1 THEN abs((y - p) / y) END) * 100, 9) AS mape_pct, count(*) FILTER (NOT abs(y) >= 1)::BIGINT AS mape_excluded"


@query("regression_metrics", f"WITH {_ROWS} SELECT {_METRICS} FROM (SELECT y, pm25 AS p FROM r)")
def regression_metrics(spark, sf):
    return rounded(m.regression_metrics(_rows(spark, sf), "y", "pm25"))


_THR = "thr AS (SELECT quantile_cont(y, 0.9) AS threshold FROM r WHERE split = 'train')"


@query("spike_threshold", f"WITH {_ROWS}, {_THR} SELECT round(threshold, 9) AS threshold FROM thr")
def spike_threshold(spark, sf):
    return rounded(m.spike_threshold(_rows(spark, sf).where("split = 'train'"), "y"))


@query("spike_classification", f"WITH {_ROWS}, {_THR}, c AS (SELECT count(*) FILTER (y >= threshold) AS a, count(*) FILTER (pm25 >= threshold) AS b, count(*) FILTER (y >= threshold AND pm25 >= threshold) AS h FROM r, thr WHERE split = 'test') SELECT a::BIGINT AS actual, b::BIGINT AS predicted, round(coalesce(h / nullif(b, 0), 0), 9) AS precision, round(coalesce(h / nullif(a, 0), 0), 9) AS recall, round(coalesce(2.0 * h / nullif(a + b, 0), 0), 9) AS f1 FROM c")
def spike_classification(spark, sf):
    r = _rows(spark, sf)
    test = r.where("split = 'test'").crossJoin(F.broadcast(m.spike_threshold(r.where("split = 'train'"), "y")))
    return rounded(m.spike_classification(test, "y", "pm25", F.col("threshold")))


@query("average_precision", "WITH s AS (SELECT n_chars AS s, count(*) FILTER (quality = 1) AS tp, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), c AS (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(tp) OVER () AS p FROM s) SELECT round(sum(tp / p * ctp / cn), 9) AS average_precision FROM c")
def average_precision(spark, sf):
    d = t.source(spark, sf, "labels").join(t.source(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(m.average_precision(d, F.col("quality") == 1, "n_chars", 64))


@query("quantile", "SELECT event_type, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY 1")
def quantile(spark, sf):
    return rounded(exact_quantiles(t.source(spark, sf, "events"), {"p90": ("value", 0.9)}, ["event_type"]))


_LONG = "long AS (SELECT 'persistence' AS model, station_id, timestamp, y, pm25 AS p FROM r WHERE split = 'test' UNION ALL SELECT 'earlier', station_id, timestamp, y, coalesce(before, pm25) FROM r WHERE split = 'test')"


def _long(spark, sf):
    r = _rows(spark, sf).where("split = 'test'")
    a = r.select(F.lit("persistence").alias("model"), "station_id", "timestamp", F.col("pm25").alias("prediction"))
    return r, a.union(r.select(F.lit("earlier"), "station_id", "timestamp", F.coalesce("before", "pm25")))


@query("keyed_predictions", f"WITH {_ROWS}, {_LONG} SELECT model, station_id, timestamp, round(p, 9) AS prediction FROM long")
def keyed_predictions(spark, sf):
    return rounded(_long(spark, sf)[1])


@query("score_models", f"WITH {_ROWS}, {_LONG} SELECT model, {_METRICS} FROM long GROUP BY model")
def score_models(spark, sf):
    r, predictions = _long(spark, sf)
    return rounded(m.score_models(r.select("station_id", "timestamp"), r.select("station_id", "timestamp", F.col("y").alias("actual")), predictions, ["station_id", "timestamp"]))


@query("reproduction_gate", f"WITH {_ROWS}, {_LONG}, s AS (SELECT model, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM long GROUP BY model) SELECT model, round(r2 + 1, 9) AS delta, abs(r2 + 1) > CASE model WHEN 'persistence' THEN 0.001 ELSE 0.01 END AS failed FROM s")
def reproduction_gate(spark, sf):
    r, predictions = _long(spark, sf)
    s = m.regression_metrics(predictions.join(r.select("station_id", "timestamp", "y"), ["station_id", "timestamp"]), "y", "prediction", ["model"])
    reported = s.select("model", F.lit(-1.0).alias("reported_r2"), F.when(F.col("model") == "persistence", "saved").otherwise("retrained").alias("kind"))
    return rounded(m.reproduction_gate(s, reported, ["model"], {"saved": 0.001, "retrained": 0.01}).select("model", "delta", "failed"))


@query("model_comparison", f"WITH {_ROWS}, l AS (SELECT 'persistence' AS model, split, y, pm25 AS p FROM r UNION ALL SELECT 'earlier', split, y, coalesce(before, pm25) FROM r), s AS (SELECT model, split, avg(abs(y - p)) AS mae FROM l GROUP BY ALL) SELECT model, round(max(mae) FILTER (split = 'train'), 9) AS mae_train, round(max(mae) FILTER (split = 'test'), 9) AS mae_test FROM s GROUP BY model")
def model_comparison(spark, sf):
    r = _rows(spark, sf)
    l = r.select(F.lit("persistence").alias("model"), "split", "y", F.col("pm25").alias("p")).union(r.select(F.lit("earlier"), "split", "y", F.coalesce("before", "pm25")))  # noqa: E741
    return rounded(m.model_comparison(m.regression_metrics(l, "y", "p", ["model", "split"]), "split", ["train", "test"], ["mae"]))


@query("model_persistence", f"WITH {_ROWS} SELECT station_id, timestamp, round(pm25, 9) AS prediction FROM r")
def model_persistence(spark, sf):
    return rounded(models.persistence(_rows(spark, sf), "pm25").select("station_id", "timestamp", "prediction"))


@query("model_linear", f"WITH {_ROWS}, b AS (SELECT regr_slope(y, pm25) AS s, regr_intercept(y, pm25) AS i FROM r WHERE split = 'train') SELECT station_id, timestamp, round(i + s * pm25, 4) AS prediction FROM r, b")
def model_linear(spark, sf):
    r = _rows(spark, sf)
    ready = models.prepare(r, r.where("split = 'train'"), ["pm25"], "y")
    fitted = models.linear().fit(ready.where("split = 'train'"))
    return rounded(fitted.transform(ready).select("station_id", "timestamp", "prediction"), 4)


#: Trees and depth of forests, rounds and depth of boosting: the sizes of the registered queries; tests set smaller ones.
FOREST, BOOSTED = (150, 14), (300, 6)
_CURRENT = {"target_pm25_h1": "pm25", "target_pm25_h2": "pm25", "target_no2_h1": "no2"}


def _matrix(spark, sf):
    """The stored matrix of tier C with split and targets, and its columns."""
    f = split.chronological_split(_everything(spark, sf))
    return t.stored(split.feature_matrix(f, split.tiers()["C"], ["station_id", "timestamp", "split", *_CURRENT])), split.matrix_columns(split.tiers()["C"])


@query("baseline_experiment")
def baseline_experiment(spark, sf):
    rows, columns = _matrix(spark, sf)
    made = {"linear": models.linear(), "forest": models.forest(*FOREST), "boosted": models.boosted(*BOOSTED)}
    return models.experiment(rows, columns, list(_CURRENT), _CURRENT, made)


@query("model_forest")
def model_forest(spark, sf):
    rows, columns = _matrix(spark, sf)
    return models.experiment(rows, columns, ["target_pm25_h1"], _CURRENT, {"forest": models.forest(*FOREST)})


@query("model_boosted")
def model_boosted(spark, sf):
    rows, columns = _matrix(spark, sf)
    return models.experiment(rows, columns, ["target_pm25_h1"], _CURRENT, {"boosted": models.boosted(*BOOSTED)})


def _everything(spark, sf):
    """The feature table with every column that a tier names; what the tables do not measure is null."""
    meta = t.stored(t.meta(spark, sf))
    return build_feature_table(_wide_panel(spark, sf, meta), meta)


def _wide_panel(spark, sf, meta):
    """The panel with weather and outlier flags, stored: the boundary between cleaning and features."""
    p = t.stored(t.panel(spark, sf))
    wide = align.weather_panel(t.weather(spark, sf), t.mapping(spark, sf), t.METRICS)
    panel = align.build_panel(p, [wide], meta, ["station_id", "timestamp"]).withColumns({c: F.lit(None).cast("double") for c in ("humidity_pct", "wind_speed_ms")})
    return t.stored(clean.flag_outliers_iqr(panel, "pm25", "pm25_is_outlier", fit_on=p))


_MADE = ["{}"] + [f"{{}}_lag_{h}h" for h in (1, 2, 3, 6, 12, 24)] + [f"{{}}_roll{f}_{n}h" for f in ("mean", "std", "max", "min") for n in (3, 6, 24)] + ["{}_roc_1h", "{}_trend_6h"]
_NAMES = {
    "A": [m.format(p) for p in ("pm25", "no2") for m in _MADE] + "pm25_is_outlier hour day_of_week is_weekend month season hour_sin hour_cos day_of_week_sin day_of_week_cos month_sin month_cos".split(),
    "B": "temperature_c humidity_pct wind_speed_ms wind_direction_deg wind_direction_sin wind_direction_cos pressure_msl_hpa precipitation_mm pressure_tendency_3h".split(),
    "C": "latitude longitude neighbor_pm25_mean neighbor_pm25_count neighbor_pm25_roc_1h nearest_neighbor_distance_km".split(),
}
_TIERS = ", ".join(f"('{tier}', '{c}')" for tier in "ABC" for inner in "ABC" if inner <= tier for c in _NAMES[inner])
_ALL_ROWS = f"{GRID}, n AS (SELECT count(*)::BIGINT AS n_rows FROM grid)"


@query("feature_tiers", f"WITH {_ALL_ROWS} SELECT tier, name, n_rows FROM (VALUES {_TIERS}) x(tier, name), n")
def feature_tiers(spark, sf):
    f = _everything(spark, sf)
    names = [(tier, c) for tier in split.tiers() for c in split.check_tier(f.columns, tier)]
    each = F.explode(F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(c).alias("name")) for tier, c in names]))
    return f.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", each.alias("e")).select("e.tier", "e.name", "n_rows")


@query("gnn_feature_columns", f"WITH {_ALL_ROWS} SELECT name, n_rows FROM (VALUES {', '.join(f"('{c}')" for c in _NAMES['A'] + _NAMES['B'])}) x(name), n")
def gnn_feature_columns(spark, sf):
    f = _everything(spark, sf)
    names = split.graph_feature_columns(split.feature_columns(f))
    return f.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(F.array(*[F.lit(c) for c in names])).alias("name"))


#: What a sequence model sees of an hour, and the channels whose gaps it is told of.
CHANNELS = ["pm25", "no2", "temperature_c", "humidity_pct", "wind_speed_ms", "wind_direction_sin", "wind_direction_cos", "pressure_msl_hpa", "precipitation_mm", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]
MASKED = ["pm25", "precipitation_mm"]
_WIDE = f"""{t.GRID}, {t.WEATHER[len(t.EV) + 2:]}, wide AS (SELECT dwd_station_id - 1000 AS station_id, timestamp, max(temperature_c) AS temperature_c, max(wind_direction_deg) AS wind_direction_deg,
 max(pressure_msl_hpa) AS pressure_msl_hpa, max(precipitation_mm) AS precipitation_mm FROM weather GROUP BY ALL),
bound AS (SELECT quantile_cont(pm25, 0.25) AS q1, quantile_cont(pm25, 0.75) AS q3 FROM panel),
known AS (SELECT p.station_id, p.timestamp, temperature_c, wind_direction_deg, pressure_msl_hpa, precipitation_mm, coalesce(pm25 < q1 - 3 * (q3 - q1) OR pm25 > q3 + 3 * (q3 - q1), false) AS pm25_is_outlier FROM panel p LEFT JOIN wide USING (station_id, timestamp), bound),
every AS (SELECT g.*, k.* EXCLUDE (station_id, timestamp), NULL::DOUBLE AS humidity_pct, NULL::DOUBLE AS wind_speed_ms, sin(radians(wind_direction_deg)) AS wind_direction_sin, cos(radians(wind_direction_deg)) AS wind_direction_cos,
 sin(2 * pi() * hour(g.timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(g.timestamp) / 24) AS hour_cos, sin(2 * pi() * (isodow(g.timestamp) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow(g.timestamp) - 1) / 7) AS day_of_week_cos,
 (pm25 IS NULL)::INT::DOUBLE AS pm25_was_missing, (precipitation_mm IS NULL)::INT::DOUBLE AS precipitation_mm_was_missing FROM grid g LEFT JOIN known k USING (station_id, timestamp))"""
_ALL_CHANNELS = CHANNELS + [f"{c}_was_missing" for c in MASKED]
_CELLS = ", ".join(f"count(v.{c})::BIGINT AS n_{c}, round(sum(v.{c} * (24 - date_diff('hour', v.timestamp, g.timestamp))), 6) AS sum_{c}" for c in _ALL_CHANNELS)


@query("sequence_windows", f"""WITH {_WIDE}, y AS (SELECT *, lead(pm25) OVER (PARTITION BY station_id ORDER BY timestamp) AS y FROM every)
SELECT g.station_id, g.timestamp, {_CELLS} FROM y g JOIN every v ON v.station_id = g.station_id AND v.timestamp BETWEEN g.timestamp - INTERVAL 23 HOUR AND g.timestamp WHERE g.y IS NOT NULL GROUP BY ALL HAVING count(*) = 24""")
def sequence_windows(spark, sf):
    """Windows of 24 hours and 15 channels: of each channel its values, and their sum weighted by their place."""
    f = prepare.missing_mask(_everything(spark, sf), MASKED)
    w = prepare.sequence_windows(f, _ALL_CHANNELS, 24, ["target_pm25_h1"])

    def cells(i: int, c: str) -> list:
        known = F.size(F.filter("window", lambda row: F.get(row, F.lit(i)).isNotNull())).cast("long")
        weighted = F.transform("window", lambda row, place: F.coalesce(F.get(row, F.lit(i)) * (place + 1), F.lit(0.0)))
        total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
        return [known.alias(f"n_{c}"), F.when(known > 0, total).alias(f"sum_{c}")]

    return rounded(w.select("station_id", "timestamp", *[x for i, c in enumerate(_ALL_CHANNELS) for x in cells(i, c)]), 6)


def _share_null(c: str) -> str:
    """SQL of a column of the feature table, from the columns of `every` and `near`."""
    for p in ("pm25", "no2"):
        if c.startswith(f"{p}_lag_"):
            return f"lag({p}, {c.split('_')[2][:-1]}) OVER w"
        if c.startswith(f"{p}_roll"):
            kind, n = c.split("_")[1][4:], int(c.split("_")[2][:-1])
            return f"{ {'mean': 'avg', 'std': 'stddev_samp'}.get(kind, kind)}({p}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        if c == f"{p}_roc_1h":
            return f"{p} - lag({p}) OVER w"
        if c == f"{p}_trend_6h":
            return f"{p} - lag({p}, 6) OVER w"
    special = {"pressure_tendency_3h": "pressure_msl_hpa - lag(pressure_msl_hpa, 3) OVER w", "neighbor_pm25_mean": "m", "neighbor_pm25_count": "c", "neighbor_pm25_roc_1h": "m - lag(m) OVER w", "nearest_neighbor_distance_km": "c", "pm25_is_outlier": "pm25_is_outlier"}
    return special.get(c, c if c in [*_NAMES["B"], "pm25", "no2"] else "1")


_EVERY_NAME = [c for tier in "ABC" for c in _NAMES[tier]]
_NEAR = f"near AS (SELECT e.station_id, v.timestamp, avg(v.pm25) AS m, count(v.pm25) AS c FROM edges e JOIN grid v ON v.station_id = e.neighbor_station_id GROUP BY ALL)"
_SHARES = f"""{_WIDE}, {t.EDGES}, {_NEAR}, cols AS (SELECT {", ".join(f"{_share_null(c)} AS {c}" for c in _EVERY_NAME)}, lead(pm25, 1) OVER w AS target_pm25_h1, lead(pm25, 2) OVER w AS target_pm25_h2, lead(no2, 1) OVER w AS target_no2_h1
 FROM every LEFT JOIN near USING (station_id, timestamp) WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)),
shares AS (SELECT {", ".join(f"round(avg(({c} IS NULL)::INT) * 100, 2) AS {c}" for c in [*_EVERY_NAME, "target_pm25_h1", "target_pm25_h2", "target_no2_h1"])} FROM cols)"""


@query("most_missing_features", f"WITH {_SHARES}, l AS (UNPIVOT (SELECT {', '.join(_EVERY_NAME)} FROM shares) ON COLUMNS(*) INTO NAME column_name VALUE pct) SELECT column_name, pct FROM l ORDER BY pct DESC, column_name LIMIT 10")
def most_missing_features(spark, sf):
    f = _everything(spark, sf)
    return m.top_k(validate.missing_percent(f, split.feature_columns(f)), [F.col("pct").desc(), F.col("column_name")], 10)


@query("feature_report", f"""WITH {_SHARES} SELECT (SELECT count(*) FROM grid)::BIGINT AS n_rows, (SELECT count(*) FROM meta)::BIGINT AS stations, {len(_EVERY_NAME)}::BIGINT AS n_features, (SELECT count(*) FROM edges)::BIGINT AS edges,
 (SELECT count(*) FROM meta WHERE station_id NOT IN (SELECT station_id FROM edges))::BIGINT AS isolated, target_pm25_h1 AS target_pm25_h1_missing_pct, target_pm25_h2 AS target_pm25_h2_missing_pct, target_no2_h1 AS target_no2_h1_missing_pct FROM shares""")
def feature_report(spark, sf):
    meta = t.stored(t.meta(spark, sf))
    edges = t.stored(align.knn_join(meta, "station_id", 5, 100.0))
    f = build_feature_table(_wide_panel(spark, sf, meta), meta, edges=edges)
    return validate.feature_report(f, edges, meta, split.feature_columns(f), "station_id")


@query("ablation_experiment")
def ablation_experiment(spark, sf):
    """The tiers with all their columns, and a fourth: weather and what two hops of messages bring of every node feature."""
    keep = ["split", "target_pm25_h1", "target_pm25_h2"]
    columns = {tier: split.matrix_columns(names) for tier, names in split.tiers().items()}
    nodes = split.graph_feature_columns(columns["C"])
    edges = t.stored(align.knn_join(t.meta(spark, sf), "station_id", 5, 100.0))
    ready = split.feature_matrix(split.chronological_split(_everything(spark, sf)), split.tiers()["C"], ["station_id", "timestamp", *keep])
    rows = t.stored(graph.message_mean(ready, edges, nodes, keep=[*keep, *columns["C"]]))
    columns["D"] = columns["B"] + [f"message_{c}" for c in nodes]
    out = [models.ablation(rows, columns, y, "pm25", models.linear) for y in ("target_pm25_h1", "target_pm25_h2")]
    return out[0].union(out[1])


_TOLD = ["pm25", "no2", "temperature_c", "pm25_lag_3h", "no2_rollmean_6h", "hour_sin"]
_HOP = ", ".join("avg({c}) AS {c}".format(c=c) for c in _TOLD)


@query("message_mean", f"""WITH {_WIDE}, {t.EDGES}, b AS (SELECT station_id AS s, neighbor_station_id AS t FROM edges UNION SELECT neighbor_station_id, station_id FROM edges),
x AS (SELECT station_id, timestamp, pm25, no2, temperature_c, hour_sin, lag(pm25, 3) OVER w AS pm25_lag_3h, avg(no2) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS no2_rollmean_6h FROM every WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)),
one AS (SELECT s AS station_id, timestamp, {_HOP} FROM b JOIN x ON x.station_id = t GROUP BY ALL), two AS (SELECT s AS station_id, timestamp, {_HOP} FROM b JOIN one ON one.station_id = t GROUP BY ALL)
SELECT x.station_id, x.timestamp, {", ".join(f"round(two.{c}, 9) AS message_{c}" for c in _TOLD)} FROM x LEFT JOIN two USING (station_id, timestamp)""")
def message_mean(spark, sf):
    """Two hops of every node feature; the result shows some of them."""
    f = _everything(spark, sf)
    columns = split.graph_feature_columns(split.tiers()["C"])
    ready = split.feature_matrix(f, columns, ["station_id", "timestamp"])
    edges = t.stored(align.knn_join(t.meta(spark, sf), "station_id", 5, 100.0))
    told = graph.message_mean(ready, edges, split.matrix_columns(columns))
    return rounded(told.select("station_id", "timestamp", *[f"message_{c}" for c in _TOLD]))
