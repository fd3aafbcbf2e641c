"""Column expressions: time parsing, calendar, circular encodings, distance, encoding of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km.
EARTH_KM = 6371.0088
#: Season of each month.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}
SEASON_ORDER = ["winter", "spring", "summer", "autumn"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_ts_24h(text: str | Column) -> Column:
    """'YYYY-MM-DD 24:00:00' is the next day's midnight; what does not parse is null."""
    t = _c(text)
    late = F.date_add(F.to_date(F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("yyyy-MM-dd"))), 1)
    return F.when(t.endswith("24:00:00"), late.cast("timestamp_ntz")).otherwise(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(_c(c)), _c(c))


def sentinel_to_null(c: str | Column, sentinel: float = -999) -> Column:
    return F.nullif(_c(c), F.lit(sentinel).cast("double"))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; null where a coordinate is."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(half > 1, 1.0).otherwise(half)))


def season(month: str | Column) -> Column:
    out = F
    for name in SEASON_ORDER:
        out = out.when(_c(month).isin([m for m, s in SEASONS.items() if s == name]), name)
    return out


def calendar(ts: str | Column) -> dict[str, Column]:
    """hour, day_of_week (Monday 0), is_weekend, month, season of a time."""
    t = _c(ts)
    return {"hour": F.hour(t), "day_of_week": F.weekday(t), "is_weekend": F.weekday(t).isin(5, 6), "month": F.month(t), "season": season(F.month(t))}


def cyclical(c: str | Column, period: int) -> tuple[Column, Column]:
    turn = _c(c) * (2 * F.pi()) / F.lit(period)
    return F.sin(turn), F.cos(turn)


def wind_components(degrees: str | Column) -> tuple[Column, Column]:
    return F.sin(F.radians(_c(degrees))), F.cos(F.radians(_c(degrees)))


def bool_to_double(c: str | Column) -> Column:
    return _c(c).cast("double")


def one_hot(c: str | Column, values: list[str]) -> dict[str, Column]:
    """Indicator columns in a fixed order, whether or not the values occur; null is none of them."""
    name = c if isinstance(c, str) else "value"
    return {f"{name}_{v}": F.coalesce(_c(c) == v, F.lit(False)).cast("double") for v in values}


def plus_hours(ts: str | Column, hours: str | Column) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), _c(hours).cast("int"))


def color_scale(value: str | Column, ceiling: str | Column) -> Column:
    """Grey for null; else from green to red by value over ceiling, as [r, g, b]."""
    t = F.greatest(F.least(_c(value) / _c(ceiling), F.lit(1.0)), F.lit(0.0))
    rgb = F.array(*[F.floor(x).cast("int") for x in (F.lit(60) + t * 195, F.lit(180) - t * 140, F.lit(90) - t * 50)])
    return F.when(_c(value).isNull(), F.array(F.lit(160), F.lit(160), F.lit(160))).otherwise(rgb)
