"""Chronological splits, leakage guards, feature lists and matrices, common rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelry.functions.scalars import SEASON_ORDER, one_hot
from panelry.operators.grid import over, pollution_features

TRAIN, VAL = 0.7, 0.15
#: The columns of the calendar, the weather and the neighbours.
CALENDAR = ["hour", "day_of_week", "is_weekend", "month", "season", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
WEATHER = ["temperature_c", "humidity_pct", "wind_speed_ms", "wind_direction_deg", "wind_direction_sin", "wind_direction_cos", "pressure_msl_hpa", "precipitation_mm", "pressure_tendency_3h"]
SPATIAL = ["latitude", "longitude", "neighbor_pm25_mean", "neighbor_pm25_count", "neighbor_pm25_roc_1h", "nearest_neighbor_distance_km"]
IDS = ("station_id", "timestamp")
#: What sums of 64-bit halves are taken modulo of.
WORD_64 = Decimal(2**64)


def boundaries(df: DataFrame, ts: str, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """(train_end, val_end) as one row: times number int(n * train) and int(n * (train + val)) of the n distinct ones.

    Only distinct times are numbered in one place.
    """
    times = df.select(ts).distinct().where(F.col(ts).isNotNull())
    n = F.count(F.lit(1)).over(W.partitionBy())
    numbered = times.select(F.col(ts).alias("_t"), F.row_number().over(W.orderBy(ts)).alias("_i"), n.alias("_n"))
    at = lambda f: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * F.lit(f)), F.col("_t")))
    return numbered.agg(at(train).alias("train_end"), at(train + val).alias("val_end"))


def chronological_split(df: DataFrame, ts: str = "timestamp", train: float = TRAIN, val: float = VAL, name: str = "split") -> DataFrame:
    """Adds train, val or test by the boundary times; no time falls into two."""
    b = boundaries(df, ts, train, val)
    label = F.when(F.col(ts) <= F.col("train_end"), "train").when(F.col(ts) <= F.col("val_end"), "val").otherwise("test")
    return df.crossJoin(F.broadcast(b)).withColumn(name, label).drop("train_end", "val_end")


def split_periods(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def chronology_violations(periods: DataFrame) -> DataFrame:
    """Pairs of neighbouring splits that overlap; empty where train < val < test."""
    place = F.element_at(F.create_map(*[F.lit(x) for p in (("train", 0), ("val", 1), ("test", 2)) for x in p]), F.col("split"))
    p = periods.withColumn("place", place)
    nxt = p.select((F.col("place") - 1).alias("place"), F.col("split").alias("later"), F.col("first_ts").alias("later_start"))
    return p.join(nxt, "place").where(F.col("last_ts") >= F.col("later_start")).select("split", "later", "last_ts", "later_start")


def feature_time_violations(df: DataFrame, feature_ts: str, prediction_ts: str) -> DataFrame:
    return df.where(F.col(feature_ts) > F.col(prediction_ts))


def target_offset_violations(df: DataFrame, target_ts: str, cutoff_ts: str, hours: int) -> DataFrame:
    return df.where(F.col(target_ts) != F.col(cutoff_ts) + F.make_dt_interval(F.lit(0), F.lit(hours)))


def require_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def _canonical(c: str, kind: str) -> Column:
    """A value as text that any engine can state.

    Floating numbers give their whole part and 2^52 times the rest, both as whole numbers: exact steps on doubles.
    """
    if kind in ("double", "float"):
        whole = F.floor(F.col(c).cast("double"))
        return F.concat(whole.cast("string"), F.lit("+"), F.floor((F.col(c).cast("double") - whole) * F.lit(2.0**52)).cast("string"))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.col(c).cast("string")


def fingerprint_state(df: DataFrame) -> DataFrame:
    """(n, a, b) as one row: rows, and the sums modulo 2^64 of both halves of each row's md5. States of parts add up.

    A row's text is its columns in order of name, each followed by a line end, null as a lone backslash and N.
    """
    kinds = dict(df.dtypes)
    text = F.concat(*[F.concat(F.coalesce(_canonical(c, kinds[c]), F.lit("\\N")), F.lit("\n")) for c in sorted(df.columns)])
    h = F.md5(text)
    half = lambda i: F.conv(F.substring(h, i, 16), 16, 10).cast("decimal(20,0)")
    total = lambda i: F.coalesce(F.sum(half(i)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) % WORD_64
    return df.agg(F.count(F.lit(1)).alias("n"), total(1).cast("decimal(20,0)").alias("a"), total(17).cast("decimal(20,0)").alias("b"))


def merged_state(states: DataFrame) -> DataFrame:
    """The state of all parts together, from the states of parts that share no row."""
    total = lambda c: (F.coalesce(F.sum(c), F.lit(0).cast("decimal(30,0)")) % WORD_64).cast("decimal(20,0)").alias(c)
    return states.agg(F.sum("n").alias("n"), total("a"), total("b"))


def fingerprint(df: DataFrame, name: str = "fingerprint", state: DataFrame | None = None) -> DataFrame:
    """12 hex digits of the content, whatever the order of the rows; repeated rows count. One aggregation."""
    columns = ",".join(sorted(df.columns))
    parts = fingerprint_state(df) if state is None else state
    return parts.select(F.left(F.md5(F.concat_ws("|", F.lit(columns), "n", "a", "b")), F.lit(12)).alias(name))


def feature_columns(df: DataFrame, ids: tuple[str, ...] = IDS) -> list[str]:
    return [c for c in df.columns if c not in ids and not c.startswith("target_")]


def graph_feature_columns(columns: list[str]) -> list[str]:
    """What a graph model gets: everything but the columns that the graph itself stands for."""
    return [c for c in columns if c not in SPATIAL]


def local_columns(pollutants: tuple[str, ...] = ("pm25", "no2")) -> list[str]:
    """The pollutants, the outlier flag, and whatever pollution_features makes of each pollutant."""
    made = [name for p in pollutants for name in pollution_features(p, over())]
    return [*pollutants, f"{pollutants[0]}_is_outlier", *made]


def tiers() -> dict[str, list[str]]:
    """Feature tiers, each containing the one before: local and calendar, weather, neighbours."""
    grown: list[str] = []
    out = {}
    for name, more in (("A", local_columns() + CALENDAR), ("B", WEATHER), ("C", SPATIAL)):
        grown = grown + more
        out[name] = grown
    return out


def check_tier(columns: list[str], tier: str) -> list[str]:
    wanted = tiers()[tier]
    missing = sorted(set(wanted) - set(columns))
    if missing:
        raise ValueError(f"tier {tier} needs {missing}")
    return wanted


def feature_matrix(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Booleans as doubles, season as four indicators, all else as doubles; order as given, null stays null."""
    out = []
    for c in columns:
        if c == "season":
            out += [v.alias(n) for n, v in one_hot(c, SEASON_ORDER).items()]
        else:
            out.append(F.col(c).cast("double").alias(c))
    return df.select(*keep, *out)


def matrix_columns(columns: list[str]) -> list[str]:
    """The names that feature_matrix() gives to these columns."""
    return [name for c in columns for name in (one_hot(c, SEASON_ORDER) if c == "season" else [c])]


def dropna_subset(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def select_common_rows(test: DataFrame, needed: list[str], keys: list[str]) -> DataFrame:
    """Keys of rows with all needed columns; running it raises if a key occurs twice."""
    rows = dropna_subset(test, needed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    once = F.assert_true(F.col("_n") == 1, F.concat(F.lit("a key occurs twice: "), F.to_json(F.struct(*keys)))).isNull()
    return rows.where(once).select(*keys)
