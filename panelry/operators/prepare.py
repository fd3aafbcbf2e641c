"""Imputation, masks, normalization and sequence windows; statistics come from the training rows given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import in_blocks, with_ffill, with_place
from .quantiles import exact_quantiles


def medians(df: DataFrame, columns: list[str], empty: float | None = None, copy: bool = True) -> DataFrame:
    """One row of exact medians of all columns, nulls skipped; `empty` for a column without values. copy: see exact_quantiles."""
    found = exact_quantiles(df, {f"_m_{c}": (c, 0.5) for c in columns}, copy=copy)
    return found if empty is None else found.fillna(empty)


def impute_median(df: DataFrame, train: DataFrame, columns: list[str], empty: float | None = 0.0) -> DataFrame:
    """Only nulls change; the medians are those of the training rows."""
    joined = df.crossJoin(F.broadcast(medians(train, columns, empty)))
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def missing_mask(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("double") for c in columns})


def station_arrays(df: DataFrame, columns: list[str], masked: list[str], key: str = "station_id", ts: str = "timestamp", fit_on: DataFrame | None = None) -> DataFrame:
    """Masks, then forward fill inside the station, then the column's median (of the whole table unless fit_on)."""
    filled = with_ffill(missing_mask(df, masked), columns, key, ts)
    return impute_median(filled, df if fit_on is None else fit_on, columns, None)


def norm_stats(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations; a deviation up to 1e-6 counts as 1."""
    out = []
    for c in columns:
        s = F.stddev_pop(c)
        out += [F.avg(c).alias(f"_mean_{c}"), F.when(s > 1e-6, s).otherwise(F.lit(1.0)).alias(f"_std_{c}")]
    return train.agg(*out)


def normalize(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(norm_stats(train, columns)))
    cols = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") for c in columns}
    return joined.withColumns(cols).drop(*[f"_{k}_{c}" for c in columns for k in ("mean", "std")])


def denormalize(df: DataFrame, train: DataFrame, prediction: str, target: str) -> DataFrame:
    joined = df.crossJoin(F.broadcast(norm_stats(train, [target])))
    return joined.withColumn(prediction, F.col(prediction) * F.col(f"_std_{target}") + F.col(f"_mean_{target}")).drop(f"_mean_{target}", f"_std_{target}")


def sequence_samples(df: DataFrame, length: int, needed: list[str], key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Rows with a full window behind them and all targets, with their place t_idx."""
    placed = with_place(df, "t_idx", key, ts)
    return placed.where(F.col("t_idx") >= length - 1).na.drop(subset=needed)


def sequence_chunks(df: DataFrame, channels: list[str], length: int, needed: list[str], key: str = "station_id", ts: str = "timestamp", block: int = 24) -> DataFrame:
    """(key, _block, rows array<struct<ts, own, ready, cells>>): the hours of a block after the length - 1 hours before it.

    df is a regular grid. Windows are slices of a chunk, so a row is stored about length / block + 1 times, not length
    times. ready: the row has all that is needed of it.
    """
    ready = F.lit(True)
    for c in needed:
        ready &= F.col(c).isNotNull()
    cell = F.array(*[F.col(c).cast("double") for c in channels])
    rows = in_blocks(df, ts, max(block, length - 1), length - 1, 0)
    one = F.struct(F.col(ts).alias("ts"), F.col("_own").alias("own"), ready.alias("ready"), cell.alias("cells"))
    return rows.groupBy(key, "_block").agg(F.array_sort(F.collect_list(one)).alias("rows"))


def sequence_windows(df: DataFrame, channels: list[str], length: int, needed: list[str], key: str = "station_id", ts: str = "timestamp", block: int = 24) -> DataFrame:
    """(key, ts, window array<array<double>>): the last `length` rows up to and with this one; rows without a full one go."""
    chunks = sequence_chunks(df, channels, length, needed, key, ts, block).where(F.size("rows") >= length)
    at = chunks.select(key, "rows", F.explode(F.sequence(F.lit(length - 1), F.size("rows") - 1)).alias("_i"))
    row = F.get("rows", F.col("_i"))
    at = at.where(row["own"] & row["ready"])
    window = F.transform(F.slice("rows", F.col("_i") - length + 2, length), lambda r: r["cells"])
    return at.select(key, row["ts"].alias(ts), window.alias("window"))
