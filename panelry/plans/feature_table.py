"""The whole feature table in one lazy plan: grid, pollution, calendar, weather, neighbours, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.functions.scalars import calendar, cyclical, wind_components
from panelry.operators import grid as g
from panelry.operators.align import dimension, knn_join
from panelry.operators.config import FeatureConfig
from panelry.operators.store import stored


def with_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    out = calendar(ts)
    for c, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
        s, k = cyclical(out[c], period)
        out |= {f"{c}_sin": s, f"{c}_cos": k}
    return df.withColumns(out)


def with_wind(df: DataFrame) -> DataFrame:
    s, k = wind_components("wind_direction_deg")
    return df.withColumns({"wind_direction_sin": s, "wind_direction_cos": k})


def with_weather(df: DataFrame, key: str = "station_id", ts: str = "timestamp") -> DataFrame:
    """Of rows that need not be a grid: the tendency is that to the third row before."""
    return with_wind(df).withColumns(g.pressure_tendency("pressure_msl_hpa", g.over(key, ts)))


def build_feature_table(panel: DataFrame, meta: DataFrame, config: FeatureConfig | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Grid, then the neighbours' means (one exchange by hour), then every window (one exchange by station and block).

    The grid is made once and joined with no other large table. edges are those of knn_join() on meta; they are stored once.
    """
    cfg = config or FeatureConfig()
    if edges is None:
        edges = stored(knn_join(meta, "station_id", cfg.neighbors, cfg.max_km))
    grid = g.regularize_grid(panel, meta)
    near = g.with_neighbor_means(grid, edges, meta, "pm25")

    def windows(w) -> dict:
        cols = {}
        for c, hours in cfg.horizons.items():
            if c in grid.columns:
                cols |= g.pollution_features(c, w, cfg.lags, cfg.windows, cfg.trend) | g.targets(c, w, hours)
        if "pressure_msl_hpa" in grid.columns:
            cols |= g.pressure_tendency("pressure_msl_hpa", w, cfg.pressure)
        return cols | {"neighbor_pm25_roc_1h": F.col("neighbor_pm25_mean") - F.lag("neighbor_pm25_mean", 1).over(w)}

    out = g.with_windows(near, windows, block=cfg.block, back=cfg.back, ahead=cfg.ahead)
    if "wind_direction_deg" in grid.columns:
        out = with_wind(out)
    nearest = edges.where("rank = 1").select("station_id", F.col("distance_km").alias("nearest_neighbor_distance_km"))
    return with_calendar(out).join(dimension(nearest), "station_id", "left")
