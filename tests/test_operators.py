"""Hand-computed cases of single operators."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelry.functions import scalars
from panelry.operators import align, clean, graph, models, prepare, scoring, split, validate
from panelry.operators import grid as g
from panelry.operators import metrics as m
from panelry.operators.store import stored
from panelry.plans.feature_table import build_feature_table
from panelry.sources import formats


def hours(n, start="2026-01-01"):
    t = dt.datetime.fromisoformat(start)
    return [t + dt.timedelta(hours=i) for i in range(n)]


def series(spark, values, station=1, c="pm25"):
    return spark.createDataFrame([(station, t, v) for t, v in zip(hours(len(values)), values, strict=True)], f"station_id long, timestamp timestamp_ntz, {c} double")


def column(df, c, order=("station_id", "timestamp")):
    return [r[c] for r in df.orderBy(*order).collect()]


def test_lags_rolls_roc_trend(spark):
    w = g.over()
    df = series(spark, [10.0, 12.0, 8.0, 20.0]).union(series(spark, [1.0, 2.0], 2))
    out = df.withColumns(g.pollution_features("pm25", w))
    assert column(out, "pm25_lag_1h") == [None, 10, 12, 8, None, 1]
    assert column(out, "pm25_rollmean_3h")[:4] == [10, 11, 10, pytest.approx(40 / 3)]
    assert column(out, "pm25_rollstd_3h")[0] is None
    assert column(out, "pm25_roc_1h")[:4] == [None, 2, -4, 12]
    t = series(spark, [10.0, 12.0, 14.0, 16.0]).withColumns(g.trend("pm25", w, 3))
    assert column(t, "pm25_trend_3h") == [None, None, None, 2.0]


def test_grid_fills_gaps_and_forgets_strangers(spark):
    t = hours(4)
    panel = spark.createDataFrame([(1, t[0], 1.0), (1, t[3], 4.0), (9, t[1], 7.0)], "station_id long, timestamp timestamp_ntz, pm25 double")
    meta = spark.createDataFrame([(1, 50.0, 9.0), (2, 51.0, 9.0)], "station_id long, latitude double, longitude double")
    out = g.regularize_grid(panel, meta)
    assert out.count() == 8 and out.where("pm25 is not null").count() == 2
    assert out.where("latitude is null").count() == 0


def test_no_feature_sees_the_future(spark):
    t = hours(48)
    rows = [(s, x, 10.0 + s + i % 5) for s in (1, 2) for i, x in enumerate(t)]
    meta = spark.createDataFrame([(1, 52.5, 13.4), (2, 52.6, 13.4)], "station_id long, latitude double, longitude double")
    kind = "station_id long, timestamp timestamp_ntz, pm25 double"
    cut = t[30]
    a = build_feature_table(spark.createDataFrame(rows, kind), meta)
    b = build_feature_table(spark.createDataFrame([(s, x, v * 9 if x > cut else v) for s, x, v in rows], kind), meta)
    keep = [c for c in a.columns if not c.startswith("target_")]
    before = F.col("timestamp") <= F.lit(cut)
    rows_of = lambda f, c: sorted(map(repr, f.select(c).collect()))
    assert rows_of(a.where(before), keep) == rows_of(b.where(before), keep)
    assert rows_of(a, "target_pm25_h1") != rows_of(b, "target_pm25_h1")


def test_knn_and_neighbours(spark):
    meta = spark.createDataFrame([(1, 52.5, 13.4), (2, 52.6, 13.4), (3, 42.5, 13.4)], "station_id long, latitude double, longitude double")
    e = align.knn_join(meta, "station_id", 5, 100.0).orderBy("station_id").collect()
    assert [(r.station_id, r.neighbor_station_id, r["rank"]) for r in e] == [(1, 2, 1), (2, 1, 1)]
    line = spark.createDataFrame([(i, 50 + i / 100, 9.0) for i in range(4)], "station_id long, latitude double, longitude double")
    assert align.knn_join(line, "station_id", 2, 100.0).groupBy("station_id").count().where("count <> 2").count() == 0
    v = series(spark, [10.0, 12.0]).union(series(spark, [20.0, None], 2))
    near = g.neighbor_features(v, align.knn_join(meta, "station_id", 5, 100.0), "pm25")
    assert column(near, "neighbor_pm25_mean") == [20, None, 10, 12]
    assert column(near, "neighbor_pm25_count") == [1, 0, 1, 1]


def test_cells_lose_no_neighbour(spark):
    rows = [(i, 47 + (i * 37 % 900) / 100, 6 + (i * 61 % 900) / 100) for i in range(150)]
    pts = spark.createDataFrame(rows, "station_id long, latitude double, longitude double")
    got = {(r.station_id, r.neighbor_station_id) for r in align.knn_join(pts, "station_id", 4, 60.0).collect()}
    a, b = pts.alias("a"), pts.alias("b")
    d = scalars.haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    near = a.crossJoin(b).where("a.station_id <> b.station_id").select(F.col("a.station_id").alias("s"), F.col("b.station_id").alias("n"), d.alias("d")).where("d <= 60").collect()
    want = set()
    for s in {r.s for r in near}:
        want |= {(s, n) for _, n in sorted((r.d, r.n) for r in near if r.s == s)[:4]}
    assert got == want


def test_neighbours_across_the_antimeridian_and_the_pole(spark):
    rows = [(1, 10.0, 179.9), (2, 10.0, -179.9), (3, 89.9, 0.0), (4, 89.9, 180.0), (5, None, 3.0)]
    pts = spark.createDataFrame(rows, "station_id long, latitude double, longitude double")
    got = {(r.station_id, r.neighbor_station_id) for r in align.knn_join(pts, "station_id", 2, 50.0).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_messages_pass_only_where_a_station_has_a_row(spark):
    """Two hops along 1 - 2 - 3, 4 alone; station 2 is absent at hour 1, its value unknown at hour 2."""
    rows = [(s, h, None if (s, h) == (2, 2) else float(10 * s + h)) for h in range(3) for s in range(1, 5) if (s, h) != (2, 1)]
    v = spark.createDataFrame(rows, "station_id long, timestamp long, pm25 double")
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 2)], "station_id long, neighbor_station_id long")
    one = {(r[0], r[1]): r[2] for r in graph.message_mean(v, edges, ["pm25"], 1).collect()}
    assert one == {(1, 0): 20, (2, 0): 20, (3, 0): 20, (4, 0): None, (1, 1): None, (3, 1): None, (4, 1): None, (1, 2): None, (2, 2): 22, (3, 2): None, (4, 2): None}
    two = {(r[0], r[1]): r[2] for r in graph.message_mean(v, edges, ["pm25"]).collect()}
    assert two == {(1, 0): 20, (2, 0): 20, (3, 0): 20, (4, 0): None, (1, 1): None, (3, 1): None, (4, 1): None, (1, 2): 22, (2, 2): None, (3, 2): 22, (4, 2): None}
    plan = graph.message_mean(v, edges, ["pm25"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "timestamp" in x and "REPARTITION_BY_COL" not in x]


def test_nearest_station_at_every_distance(spark):
    """Near, far, tied, antipodal and repeated places, against all pairs."""
    places = [(i, 47 + (i * 37 % 900) / 100, 6 + (i * 61 % 900) / 100) for i in range(60)]
    places += [(60, 0.0, 0.0), (61, 0.001, -0.001), (62, -89.99, 17.0), (63, 0.0, 179.999), (64, -33.9, 151.2)]
    sites = [(i, "a", 47 + (i * 71 % 900) / 100, 6 + (i * 13 % 900) / 100) for i in range(40)]
    sites += [(50, "a", -0.001, 0.001), (51, "a", 52.0, 9.0), (52, "a", 52.0, 9.0), (53, "b", 52.0, -171.0), (54, "a", None, 9.0)]
    points = spark.createDataFrame([*places, (65, None, 1.0)], "id long, lat double, lon double")
    stations = spark.createDataFrame(sites, "sid long, kind string, lat double, lon double")
    got = {(r.id, r.kind): (r.sid, round(r.distance_km, 6)) for r in align.nearest_join(points, stations, "id", "sid", ["kind"]).collect()}
    pairs = points.join(stations.withColumnsRenamed({"lat": "y", "lon": "x"}), F.lit(True)).withColumn("d", scalars.haversine("lat", "lon", "y", "x"))
    want = {}
    for r in sorted(pairs.where("d is not null").collect(), key=lambda r: (r.d, r.sid)):
        want.setdefault((r.id, r.kind), (r.sid, round(r.d, 6)))
    assert got == want and len(got) == 2 * len(places)
    assert align.nearest_join(points, stations.limit(0), "id", "sid", ["kind"]).count() == 0


def test_clean(spark):
    d = spark.createDataFrame([(1, 1, 10, 0), (1, 1, 99, 1), (2, 2, 20, 2)], "station_id long, ts long, value long, seq long")
    assert sorted(r.value for r in clean.dedup_first(d, ["station_id", "ts"], ["seq"]).collect()) == [10, 20]
    v = spark.createDataFrame([(x,) for x in [5.0, 6.0, 5.0, 6.0, 5.0, 6.0, 5.0, 500.0]], "value double")
    assert [r.value for r in clean.flag_outliers_iqr(v, "value", "o").where("o").collect()] == [500]
    p = spark.createDataFrame([(5.0,), (-1.0,), (None,), (9999.0,), (10.0,)], "value double")
    kept = clean.drop_impossible(p, "value", 0, 2000)
    assert kept.count() == 3 and kept.where("value is null").count() == 1
    assert clean.dropped(p, kept).first().dropped == 2


def test_validation_rules(spark):
    t = hours(1)[0]
    kind = "station_id long, component_id long, scope_id long, value double, ts_start timestamp_ntz, ts_end timestamp_ntz, quality_index string"
    ok = (1, 5, 2, 3.0, t, t + dt.timedelta(hours=1), None)
    validate.validate_or_raise(spark.createDataFrame([ok], kind), validate.measure_rules(), "measures")
    for bad in ((1, 5, 1, 3.0, t, t + dt.timedelta(hours=1), None), (1, 5, 2, 3.0, t, t + dt.timedelta(hours=3), None)):
        with pytest.raises(ValueError):
            validate.validate_or_raise(spark.createDataFrame([bad], kind), validate.measure_rules(), "measures")


def test_weather_and_panel(spark):
    t = hours(3)
    w = spark.createDataFrame([(7, t[0], "air_temperature", 5.0, None), (7, t[0], "pressure", None, 1000.0)], "dwd_station_id long, timestamp timestamp_ntz, parameter string, temperature_c double, pressure_msl_hpa double")
    one = align.collapse_sparse(w, ["dwd_station_id", "timestamp"], ["temperature_c", "pressure_msl_hpa"]).collect()
    assert len(one) == 1 and (one[0].temperature_c, one[0].pressure_msl_hpa) == (5, 1000)
    mapping = spark.createDataFrame([(1, "air_temperature", 7), (2, "air_temperature", 999)], "station_id long, parameter string, dwd_station_id long")
    wide = align.weather_panel(w, mapping, {"air_temperature": ["temperature_c"]})
    meta = spark.createDataFrame([(1, 50.0, 9.0), (2, 51.0, 9.0)], "station_id long, latitude double, longitude double")
    out = align.build_panel(series(spark, [1.0, 2.0]).union(series(spark, [3.0], 2)), [wide], meta, ["station_id", "timestamp"])
    assert out.count() == 3 and column(out, "temperature_c") == [5, None, None]


def test_scalars(spark):
    row = spark.createDataFrame([("2026-09-20 24:00:00", "2026-01-05 08:00:00", "x")], "a string, b string, c string").select(*[scalars.parse_ts_24h(c).alias(c) for c in "abc"]).first()
    assert row.a == dt.datetime(2026, 9, 21) and row.b == dt.datetime(2026, 1, 5, 8) and row.c is None
    d = spark.range(1).select(scalars.haversine(F.lit(52.52), F.lit(13.405), F.lit(48.137), F.lit(11.575)).alias("d")).first().d
    assert abs(d - 504) < 10
    c = series(spark, [1.0]).select(*[v.alias(k) for k, v in scalars.calendar(F.lit(dt.datetime(2026, 1, 10, 14))).items()]).first()
    assert (c.hour, c.day_of_week, c.is_weekend, c.month, c.season) == (14, 5, True, 1, "winter")


def test_split_and_guards(spark):
    df = series(spark, [1.0] * 100)
    s = split.chronological_split(df)
    assert {r.split: r.n for r in split.split_periods(s, "timestamp").collect()} == {"train": 70, "val": 15, "test": 15}
    assert split.chronology_violations(split.split_periods(s, "timestamp")).count() == 0
    x = df.withColumn("late", F.col("timestamp") + F.expr("interval 2 hours"))
    assert split.target_offset_violations(x, "late", "timestamp", 1).count() == 100
    with pytest.raises(ValueError):
        split.require_empty(split.feature_time_violations(x, "late", "timestamp"), "feature from the future")
    with pytest.raises(PySparkException, match="a key occurs twice"):
        split.select_common_rows(df.union(df), ["pm25"], ["station_id", "timestamp"]).collect()
    assert [len(split.tiers()[x]) for x in "ABC"] == [54, 63, 69]
    with pytest.raises(ValueError):
        split.check_tier(["pm25"], "A")
    a, b = split.fingerprint(df).first()[0], split.fingerprint(df.orderBy(F.desc("timestamp"))).first()[0]
    assert a == b != split.fingerprint(df.withColumn("pm25", F.col("pm25") + 1)).first()[0]
    for other in (df.union(df.limit(1)), df.limit(99), df.withColumn("pm25", F.when(F.hour("timestamp") > 0, F.col("pm25")))):
        assert split.fingerprint(other).first()[0] != a
    assert split.fingerprint(df.union(df)).first()[0] != split.fingerprint(df.limit(0)).first()[0]
    early = F.col("timestamp") < F.lit(dt.datetime(2026, 1, 2))
    parts = split.fingerprint_state(df.where(early)).union(split.fingerprint_state(df.where(~early)))
    assert split.fingerprint(df, state=split.merged_state(parts)).first()[0] == a


def test_feature_table_has_all_of_tier_c(spark):
    t = hours(30)
    cols = ["temperature_c", "humidity_pct", "wind_speed_ms", "wind_direction_deg", "pressure_msl_hpa", "precipitation_mm"]
    rows = [(s, x, 1.0 * i, 2.0, False, *[1.0] * 6) for s in (1, 2) for i, x in enumerate(t)]
    panel = spark.createDataFrame(rows, "station_id long, timestamp timestamp_ntz, pm25 double, no2 double, pm25_is_outlier boolean, " + ", ".join(f"{c} double" for c in cols))
    meta = spark.createDataFrame([(1, 52.5, 13.4), (2, 52.6, 13.4)], "station_id long, latitude double, longitude double")
    f = build_feature_table(panel, meta)
    assert set(split.feature_columns(f)) == set(split.check_tier(f.columns, "C"))
    assert len(split.feature_matrix(f, split.tiers()["C"], ["station_id"]).columns) == 73


def test_metrics(spark):
    r = m.regression_metrics(spark.createDataFrame([(10.0, 12.0), (20.0, 16.0)], "y double, p double"), "y", "p").first()
    assert r.mae == 3 and r.rmse == pytest.approx(10**0.5)
    r = m.regression_metrics(spark.createDataFrame([(10.0, 11.0), (0.0, 5.0)], "y double, p double"), "y", "p").first()
    assert r.mape_pct == pytest.approx(10) and r.mape_excluded == 1
    assert m.regression_metrics(spark.createDataFrame([(0.1, 5.0)], "y double, p double"), "y", "p").first().mape_pct is None
    s = m.spike_classification(spark.createDataFrame([(20.0, 20.0), (20.0, 1.0), (1.0, 1.0)], "y double, p double"), "y", "p", F.lit(15.0)).first()
    assert (s.precision, s.recall) == (1, 0.5)
    ap = spark.createDataFrame([(1, 14.9), (0, 3.0), (0, 2.0)], "t int, s double")
    assert m.average_precision(ap, F.col("t") == 1, "s").first()[0] == 1


def test_average_precision_does_not_depend_on_its_ranges(spark):
    rows = [((i * 7919) % 3 == 0, float((i * 104729) % 57)) for i in range(400)]
    df = spark.createDataFrame([(int(a), b) for a, b in rows], "t int, s double")
    pos, seen, hit, want = sum(a for a, _ in rows), 0, 0, 0.0
    for score in sorted({b for _, b in rows}, reverse=True):
        tp = sum(a for a, b in rows if b == score)
        hit, seen = hit + tp, seen + sum(b == score for _, b in rows)
        want += tp / pos * hit / seen
    for buckets in (2, 16, 4096):
        assert m.average_precision(df, F.col("t") == 1, "s", buckets).first()[0] == pytest.approx(want)


def test_strict_alignment(spark):
    k = series(spark, [1.0, 2.0])
    p = k.select(F.lit("a").alias("model"), "station_id", "timestamp", F.col("pm25").alias("prediction"))
    keys = ["station_id", "timestamp"]
    assert m.score_models(k, k.withColumnRenamed("pm25", "actual"), p, keys).first().mae == 0
    with pytest.raises(PySparkException, match="missing"):
        m.score_models(k, k.withColumnRenamed("pm25", "actual"), p.limit(1), keys).collect()
    with pytest.raises(PySparkException, match="duplicate"):
        align.strict_align(p.union(p), k, keys).count()


def test_prepare(spark):
    df = series(spark, [None, 10.0, None, 30.0]).union(series(spark, [None, None], 2))
    out = prepare.station_arrays(df, ["pm25"], ["pm25"])
    assert column(out, "pm25") == [20, 10, 10, 30, 20, 20]
    assert column(out, "pm25_was_missing") == [1, 0, 1, 0, 1, 1]
    w = prepare.sequence_windows(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), ["pm25"], 3, ["pm25"])
    assert [r.window[-1][0] for r in w.orderBy("timestamp").collect()] == [3, 4, 5]


def test_graph(spark):
    order = spark.createDataFrame([(10,), (20,), (30,)], "station_id long")
    e = spark.createDataFrame([(10, 20), (20, 10)], "station_id long, neighbor_station_id long")
    assert sorted(map(tuple, graph.edge_symmetrize(e, order).collect())) == [(0, 1), (1, 0)]
    with pytest.raises(PySparkException, match="outside the order"):
        graph.edge_symmetrize(spark.createDataFrame([(10, 99)], e.schema), order).collect()
    s = graph.graph_snapshots(series(spark, [1.0], 10), order, ["pm25"]).first()
    assert [n.features for n in s.nodes] == [[1.0], None, None]
    tiles = graph.graph_snapshots(series(spark, [1.0], 30), order, ["pm25"], tile=2).orderBy("tile").collect()
    assert [(r.tile, [(n.pos, n.features) for n in r.nodes]) for r in tiles] == [(0, [(0, None), (1, None)]), (1, [(2, [1.0])])]


def test_sources(spark):
    p = spark.createDataFrame([('{"7": {"2026-01-01 23:00:00": [5, 2, null, "2026-01-01 24:00:00", "1"]}}',)], "payload string")
    r = formats.parse_measures(p).first()
    assert (r.station_id, r.component_id, r.value, r.ts_end) == (7, 5, None, dt.datetime(2026, 1, 2))
    w = spark.createDataFrame([("  44", "2026010105", " -999", "1001.5")], "STATIONS_ID string, MESS_DATUM string, P0 string, P string")
    r = formats.parse_weather(w, "pressure").first()
    assert (r.dwd_station_id, r.timestamp, r.pressure_msl_hpa) == (44, dt.datetime(2026, 1, 1, 5), 1001.5)


def test_files_round_trip(spark, tmp_path):
    df = series(spark, [1.0, float("nan"), None])
    formats.write_parquet(df, f"{tmp_path}/p")
    assert formats.read_parquet(spark, f"{tmp_path}/p").where("pm25 is null").count() == 2
    formats.write_csv(df.select("station_id"), f"{tmp_path}/c")
    assert formats.read_csv(spark, f"{tmp_path}/c", "station_id long").count() == 3
    assert formats.read_csv(spark, f"{tmp_path}/never_written", "station_id long").count() == 0
    with open(f"{tmp_path}/list.txt", "w", encoding="latin-1") as f:
        f.write("Stations_id von bis\n----- ----\n00044 20070401 20240101             44     52.9336    8.2370 " + "Großenkneten".ljust(40) + " " + "Niedersachsen".ljust(40) + "\n\n")
    r = formats.read_fixed_width(spark, f"{tmp_path}/list.txt").collect()
    assert len(r) == 1 and r[0].station_id == 44 and r[0].station_name == "Großenkneten" and r[0].latitude == 52.9336
    with open(f"{tmp_path}/w.txt", "w") as f:
        f.write("STATIONS_ID;MESS_DATUM;QN_9;TT_TU;RF_TU;eor\n   44;2026010100;3;  -999;  88.0;eor\n")
    r = formats.read_weather_text(spark, f"{tmp_path}/w.txt", "air_temperature").first()
    assert r.temperature_c is None and r.humidity_pct == 88


def test_models_and_scoring(spark):
    df = split.chronological_split(series(spark, [float(i % 7) for i in range(60)])).withColumns({"y": F.lead("pm25", 1).over(g.over())})
    out = models.experiment(df, ["pm25"], ["y"], {"y": "pm25"}, {"linear": models.linear(), "forest": models.forest(3, 3), "boosted": models.boosted(2, 2)})
    assert out.count() == 12
    req = spark.createDataFrame([(1, 1, None, None, None), (2, 5, None, None, None), (3, 1, "no2", 2, None)], "request_id long, station_id long, pollutant string, horizon int, as_of timestamp_ntz")
    served = spark.createDataFrame([("pm25", 1)], "pollutant string, horizon int")
    errors = {r.request_id: r.error for r in scoring.request_errors(req, df, served).collect()}
    assert errors == {2: "unknown station", 3: "model unavailable"}
    assert scoring.score(req, df, {("pm25", 1): F.col("pm25")}, "v").count() == 1


def test_blocks_equal_whole_stations(spark):
    """Windows, fills and places over blocks against windows over whole stations, with gaps, and a station of many blocks."""
    t = hours(400, "2025-12-30T00:30:00")
    rows = [(s, x, None if (i * 7 + s) % 5 == 0 or 100 < i < 190 else float((i * 13 + s * 5) % 41)) for s, n in ((1, 400), (2, 30), (3, 1)) for i, x in enumerate(t[:n])]
    df = spark.createDataFrame(rows, "station_id long, timestamp timestamp_ntz, pm25 double")
    make = lambda w: g.pollution_features("pm25", w) | g.targets("pm25", w, (1, 2))
    names = list(make(g.over()))
    keys = ["station_id", "timestamp"]
    rows_of = lambda f: sorted(map(repr, f.select(*keys, *names).collect()))
    blocked = g.with_windows(df, make, block=30, back=24, ahead=2)
    assert rows_of(blocked) == rows_of(df.withColumns(make(g.over())))
    tasks = g.in_blocks(df, block=30, back=24, ahead=2).groupBy("station_id", "_block").count()
    assert tasks.agg(F.max("count")).first()[0] <= 30 + 24 + 2
    with pytest.raises(ValueError):
        g.in_blocks(df, block=20)
    names = ["pm25", "t_idx"]
    plain = df.withColumns({"t_idx": (F.row_number().over(g.over()) - 1).cast("long"), "pm25": g.ffill("pm25", g.over())})
    assert rows_of(g.with_place(g.with_ffill(df, ["pm25"], block=24), block=24)) == rows_of(plain)


def test_hot_station_is_spread_over_tasks(spark):
    """One station with nearly all rows: no partition of the windows' exchange holds more than a small part of them."""
    hot = spark.range(60_000).select(F.lit(1).cast("long").alias("station_id"), (F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("timestamp"), (F.col("id") % 97).cast("double").alias("pm25"))
    out = g.with_windows(hot, lambda w: g.lag_features("pm25", w, (24,)), back=24, ahead=0)
    sizes = [r[0] for r in g.in_blocks(hot).repartition(16, "station_id", "_block").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 12 and max(sizes) < 0.2 * 60_000
    assert out.where("pm25_lag_24h is null").count() == 24 and out.count() == 60_000


def test_dense_place_meets_few_others(spark):
    """20,000 points in a square of 1 km, 1,000 of them at one place, and some far away."""
    n, k = 20_000, 5
    golden = lambda m: (F.col("id") * F.lit(m)) % 1
    dense = spark.range(n).select(F.col("id").alias("station_id"), (50 + golden(0.7548776662466927) * 0.009).alias("latitude"), (9 + golden(0.5698402909980532) * 0.014).alias("longitude"))
    dense = dense.withColumns({c: F.when(F.col("station_id") < 1000, v).otherwise(F.col(c)) for c, v in (("latitude", 50.001), ("longitude", 9.001))})
    far = spark.createDataFrame([(n + 1, 51.0, 9.0), (n + 2, 51.3, 9.0), (n + 3, -10.0, 0.0)], dense.schema)
    points = dense.union(far).cache()
    pairs = align.knn_candidates(points, "station_id", k, 100.0).groupBy("id0").count()
    assert pairs.where(F.col("id0") < n).agg(F.avg("count")).first()[0] < 1500
    got = align.knn_join(points, "station_id", k, 100.0).cache()
    assert got.where(F.col("station_id") < n).count() == k * n
    for i in (0, 999, 1000, 7777, n + 1, n + 2, n + 3):
        one = points.where(F.col("station_id") == i).select(F.col("latitude").alias("y"), F.col("longitude").alias("x"))
        want = points.where(F.col("station_id") != i).crossJoin(F.broadcast(one)).select("station_id", scalars.haversine("y", "x", "latitude", "longitude").alias("d")).where("d <= 100").orderBy("d", "station_id").limit(k)
        mine = got.where(F.col("station_id") == i).orderBy("rank")
        assert [r.neighbor_station_id for r in mine.collect()] == [r.station_id for r in want.collect()], i


def test_one_day_rewritten(spark, tmp_path):
    t = hours(60)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id long, ts timestamp_ntz").withColumn("day", F.to_date("ts"))
    path = str(tmp_path / "days")
    formats.write_by_day(df, path, "day")
    before = {p: p.stat().st_mtime_ns for p in sorted((tmp_path / "days").glob("day=*/*.parquet"))}
    formats.write_by_day(df.where("day = '2026-01-02'").withColumn("id", -F.col("id")), path, "day")
    after = {p: p.stat().st_mtime_ns for p in sorted((tmp_path / "days").glob("day=*/*.parquet"))}
    assert {p for p in before if "01-02" not in str(p)} == {p for p in after if before.get(p) == after[p]}
    read = spark.read.parquet(path)
    assert read.count() == 60 and {r.id < 0 for r in read.where("day = '2026-01-02'").collect()} == {True}
    pruned = read.where("day = '2026-01-01'")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() == 24


def test_failing_values_are_shown(spark):
    df = spark.createDataFrame([(1, 5.0), (1, -2.0), (2, -7.25), (3, None)], "k long, v double")
    found = {(r.column_name, r.check_name): (r.failures, r.lowest, r.highest) for r in validate.validate(df, validate.Rules({"v": ("double", False, True)}, (validate.ge("v", 0), validate.le("v", 9)), ("k",))).collect()}
    assert found["v", "ge(0)"] == (2, "-7.25", "-2.0") and found["v", "le(9)"] == (0, None, None)
    assert found["v", "not_null"] == (1, None, None) and found["k", "unique"] == (1, '{"k":1}', '{"k":1}')
    with pytest.raises(ValueError, match="-7.25"):
        validate.validate_or_raise(df, validate.Rules({}, (validate.ge("v", 0),)), "x")


def test_configuration(spark):
    from panelry.operators.config import FeatureConfig

    c = FeatureConfig()
    assert (c.back, c.ahead) == (24, 2)
    with pytest.raises(ValueError):
        FeatureConfig(lags=(0,))
    with pytest.raises(ValueError):
        FeatureConfig(block=12)
    panel = series(spark, [float(i) for i in range(60)])
    meta = spark.createDataFrame([(1, 50.0, 9.0)], "station_id long, latitude double, longitude double")
    f = build_feature_table(panel, meta, FeatureConfig(lags=(5,), windows=(2,), trend=3, horizons={"pm25": (4,)}, block=24))
    assert {"pm25_lag_5h", "pm25_rollmean_2h", "pm25_trend_3h", "target_pm25_h4"} <= set(f.columns) and "pm25_lag_1h" not in f.columns
    assert column(f, "pm25_lag_5h")[:7] == [None] * 5 + [0, 1] and column(f, "target_pm25_h4")[-5:] == [59, None, None, None, None]


def test_feature_table_exchanges_its_rows_twice(spark):
    """Once by hour for the neighbours, once by station and block for all windows; the rest joins small sides."""
    meta = spark.createDataFrame([(i, 52.5 + i / 100, 13.4) for i in range(4)], "station_id long, latitude double, longitude double")
    panel = series(spark, [1.0, 2.0, 3.0], 1).union(series(spark, [4.0, 5.0], 2))
    from panelry.operators.store import stored

    plan = build_feature_table(stored(panel), stored(meta))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "timestamp" in x or "_block" in x and "Exchange hashpartitioning" in x]
    assert len([x for x in exchanges if "_block" in x]) == 1
    assert len([x for x in exchanges if "REPARTITION_BY_COL" in x]) == 1


def test_experiments_write_scores_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr("panelry.operators.models.stored", lambda df: written.append(df.columns) or stored(df))
    df = split.chronological_split(series(spark, [float(i % 7) for i in range(60)])).withColumns({"y": F.lead("pm25", 1).over(g.over()), "z": F.lag("pm25", 1).over(g.over())})
    models.experiment(df, ["pm25"], ["y"], {"y": "pm25"}, {"linear": models.linear()})
    rows = models.ablation(df, {"A": ["pm25"], "B": ["pm25", "z"]}, "y", "pm25", models.linear).collect()
    assert {r.model for r in rows} == {"A", "B"} and len(rows) == 6
    assert written and all("rmse" in columns for columns in written)


def test_messages_keep_the_own_columns(spark):
    df = spark.createDataFrame([(1, 0, 1.0, "a"), (2, 0, 3.0, "b"), (3, 0, None, None), (1, 1, 5.0, "c")], "station_id long, timestamp long, x double, name string")
    edges = spark.createDataFrame([(1, 2)], "station_id long, neighbor_station_id long")
    got = graph.message_mean(df, edges, ["x"], hops=1, keep=["x", "name"]).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1.0, "a", 3.0), (2, 0, 3.0, "b", 1.0), (3, 0, None, None, None), (1, 1, 5.0, "c", None)}


def test_nearest_join_far_and_dense(spark, monkeypatch):
    """6,000 stations on two by three degrees, 50 at one place; points among them, 200 km away, and at the other end of the
    earth: the right station, and few of them met."""
    sites = [(i, "p", 50.0 + (i * 37 % 199) / 100, 9.0 + (i * 53 % 307) / 100) for i in range(6000)] + [(9000 + i, "p", 50.0, 9.0) for i in range(50)]
    points = [(i, 50.003 + i * 0.1, 9.002 + i * 0.15) for i in range(20)] + [(100 + i, 53.8 + i * 0.1, 9.0 + i * 0.15) for i in range(20)]
    odd = [(200, -50.004, -171.0), (201, 90.0, 0.0), (202, 0.0, 180.0), (203, 50.0, 9.0)]
    s = spark.createDataFrame(sites, "sid long, parameter string, lat double, lon double")
    p = spark.createDataFrame(points + odd, "pid long, lat double, lon double")
    got = {r.pid: (r.sid, r.distance_km) for r in align.nearest_join(p, s, "pid", "sid", ["parameter"]).collect()}
    pairs = p.crossJoin(s.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}))
    far = pairs.groupBy("pid").agg(F.min(F.struct(scalars.haversine("lat", "lon", "_lat", "_lon").alias("d"), "sid")).alias("m")).collect()
    assert got == {r.pid: (r.m.sid, r.m.d) for r in far}
    # A distance that counts how often it is asked for: points far away met every station before.
    met = F.udf(lambda a, b, c, d: seen.add(1) or 1.0, "double").asNondeterministic()
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(align, "haversine", lambda *a: met(*a))
    align.nearest_join(p.where("pid < 200"), s, "pid", "sid", ["parameter"]).collect()
    assert 40 <= seen.value < 40 * 600
