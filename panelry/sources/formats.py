"""Sources and sinks: Parquet, CSV, JSON payloads, fixed-width and semicolon text. Parsing only; nothing is downloaded."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelry.functions.scalars import nan_to_null, parse_ts_24h, sentinel_to_null

#: Order of the registry's array fields.
STATION_FIELDS = ["station_id", "station_code", "station_name", "station_city", "station_synonym", "active_from", "active_to", "longitude", "latitude", "network_id", "station_setting_id", "station_type_id", "network_code", "network_name", "station_setting_name", "station_setting_short_name", "station_type_name", "street", "street_nr", "zip_code"]
STATION_CASTS = {"station_id": "long", "longitude": "double", "latitude": "double", "network_id": "long", "station_setting_id": "long", "station_type_id": "long"}
#: Product columns to metric names. Sea-level pressure is P, not P0.
PARAMETER_COLUMNS = {"air_temperature": {"TT_TU": "temperature_c", "RF_TU": "humidity_pct"}, "wind": {"F": "wind_speed_ms", "D": "wind_direction_deg"}, "pressure": {"P": "pressure_msl_hpa"}, "precipitation": {"R1": "precipitation_mm"}}
#: Column slices of the station list (name, start, length).
STATION_SLICES = [("station_id", 1, 5), ("von_datum", 7, 8), ("bis_datum", 16, 8), ("height_m", 25, 14), ("latitude", 40, 11), ("longitude", 52, 9), ("station_name", 62, 41), ("bundesland", 103, 41)]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """NaN becomes null in every floating column, so that missing has one form."""
    df = spark.read.parquet(path)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_by_day(df: DataFrame, path: str, day: str, rows_a_file: int = 5_000_000) -> None:
    """A folder a day. Days that the table holds replace what was written for them; other days stay as they are.

    Rows are dealt to tasks by day, so that a day has few files; a day beyond rows_a_file gets several, and a hot day is
    split over tasks by the adaptive rebalancing of the exchange.
    """
    rows = df.hint("rebalance", day)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).partitionBy(day).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a results file; a file that is not there has none."""
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def json_report(df: DataFrame, name: str = "report") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def parse_measures(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """{station: {ts_start: [component, scope, value, ts_end, quality]}} as long rows; a null value stays null."""
    kind = "map<string, map<string, array<string>>>"
    by_station = payloads.select(F.explode(F.from_json(text, kind)).alias("station", "hours"))
    rows = by_station.select("station", F.explode("hours").alias("start", "cells"))
    cell = lambda i, t: F.try_element_at("cells", F.lit(i)).try_cast(t)
    return rows.select(F.col("station").try_cast("long").alias("station_id"), cell(1, "long").alias("component_id"), cell(2, "long").alias("scope_id"), cell(3, "double").alias("value"), parse_ts_24h("start").alias("ts_start"), parse_ts_24h(F.try_element_at("cells", F.lit(4))).alias("ts_end"), cell(5, "string").alias("quality_index"))


def parse_stations(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """{key: [20 fields]} as named, cast columns; dates that do not parse are null."""
    rows = payloads.select(F.explode(F.map_values(F.from_json(text, "map<string, array<string>>"))).alias("cells"))
    out = []
    for i, name in enumerate(STATION_FIELDS):
        c = F.try_element_at("cells", F.lit(i + 1))
        if name in ("active_from", "active_to"):
            c = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
        out.append(c.try_cast(STATION_CASTS.get(name, "string") if not name.startswith("active") else "timestamp_ntz").alias(name))
    return rows.select(*out)


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    return parse_fixed_width(spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("line string").csv(path), "line")


def parse_fixed_width(lines: DataFrame, line: str = "line") -> DataFrame:
    """Header lines and blanks have no number in the id slice and go."""
    cut = {name: F.trim(F.substring(line, start, size)) for name, start, size in STATION_SLICES}
    date = lambda c: F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    casts = {"station_id": "long", "height_m": "double", "latitude": "double", "longitude": "double"}
    cols = [date(c).alias(n) if n.endswith("datum") else c.try_cast(casts.get(n, "string")).alias(n) for n, c in cut.items()]
    return lines.select(*cols).where(F.col("station_id").isNotNull())


def read_weather_text(spark: SparkSession, path: str, parameter: str) -> DataFrame:
    df = spark.read.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return parse_weather(df.toDF(*[c.strip() for c in df.columns]), parameter)


def parse_weather(df: DataFrame, parameter: str, sentinel: float = -999) -> DataFrame:
    """Trimmed text columns of one product to typed, renamed ones; the sentinel becomes null in the metrics only."""
    metrics = [sentinel_to_null(F.trim(c).try_cast("double"), sentinel).alias(n) for c, n in PARAMETER_COLUMNS[parameter].items()]
    time = F.try_to_timestamp(F.trim("MESS_DATUM"), F.lit("yyyyMMddHH")).cast("timestamp_ntz").alias("timestamp")
    return df.select(F.trim("STATIONS_ID").try_cast("long").alias("dwd_station_id"), time, F.lit(parameter).alias("parameter"), *metrics)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def manifest(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row per source: rows, keys and window; tables maps a name to (rows, key column, time column)."""
    each = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(k).alias("n_keys"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts")).select(F.lit(n).alias("source"), "*") for n, (df, k, t) in tables.items()]
    return union_sources(each)
