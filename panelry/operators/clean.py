"""Filters and cleaning: windows, memberships, duplicates, impossible values, outlier flags. Missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .align import dimension
from .quantiles import exact_quantiles


def filter_window(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Half-open: start <= ts < end."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def reporting_ids(df: DataFrame, key: str, ts: str, day, component: Column | None = None) -> DataFrame:
    """Distinct keys that report on a day (of one component)."""
    rows = df if component is None else df.where(component)
    return rows.where(F.to_date(ts) == F.lit(day).cast("date")).select(key).distinct()


def semi_join_reporting(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def first_n_ids(ids: DataFrame, key: str, n: int) -> DataFrame:
    return ids.select(key).distinct().orderBy(key).limit(n)


def active_filter(df: DataFrame, until: str, as_of, days: int = 30) -> DataFrame:
    return df.where(F.col(until) >= F.lit(as_of).cast("date") - F.make_dt_interval(F.lit(days)))


def drop_invalid_ts(df: DataFrame, ts: str, low, high) -> DataFrame:
    """Closed interval; a null time goes."""
    return df.where(F.col(ts).between(F.lit(low), F.lit(high)))


def drop_impossible(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Values outside the closed interval go, nulls stay."""
    return df.where(F.col(value).isNull() | F.col(value).between(low, high))


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def dropped(before: DataFrame, after: DataFrame, name: str = "dropped") -> DataFrame:
    """How many rows a cleaning step took, as one row."""
    a, b = before.agg(F.count(F.lit(1)).alias("_a")), after.agg(F.count(F.lit(1)).alias("_b"))
    return a.crossJoin(F.broadcast(b)).select((F.col("_a") - F.col("_b")).alias(name))


def iqr_bounds(df: DataFrame, value: str, factor: float, by: list[str]) -> DataFrame:
    q = exact_quantiles(df, {"_q1": (value, 0.25), "_q3": (value, 0.75)}, by)
    width = factor * (F.col("_q3") - F.col("_q1"))
    return q.select(*by, (F.col("_q1") - width).alias("_low"), (F.col("_q3") + width).alias("_high"))


def flag_outliers_iqr(df: DataFrame, value: str, flag: str, factor: float = 3.0, by: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Strictly outside Q1 - f IQR .. Q3 + f IQR; null is no outlier; no row goes.

    The quartiles are exact, those of all rows, of each group, or of fit_on. One row of bounds (or one per group) is joined.
    """
    bounds = iqr_bounds(df if fit_on is None else fit_on, value, factor, by or [])
    joined = df.join(dimension(bounds), by, "left") if by else df.crossJoin(F.broadcast(bounds))
    out = F.coalesce((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high")), F.lit(False))
    return joined.withColumn(flag, out).drop("_low", "_high")
