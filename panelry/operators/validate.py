"""Declared checks, all counted in one pass over the table; keys in one more."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plausible box and concentration.
LAT_RANGE, LON_RANGE, MAX_CONCENTRATION = (46.0, 56.0), (5.0, 16.0), 2000.0


@dataclass(frozen=True)
class Check:
    """name, and the condition that holds for good rows; null conditions count as good."""

    column: str
    name: str
    holds: Column


def ge(c: str, low) -> Check:
    return Check(c, f"ge({low})", F.col(c) >= low)


def le(c: str, high) -> Check:
    return Check(c, f"le({high})", F.col(c) <= high)


def eq(c: str, v) -> Check:
    return Check(c, f"eq({v})", F.col(c) == v)


def in_range(c: str, low, high) -> Check:
    return Check(c, f"in_range({low}, {high})", F.col(c).between(low, high))


def isin(c: str, values: list) -> Check:
    return Check(c, "isin", F.col(c).isin(values))


def row_expr(name: str, holds: Column) -> Check:
    return Check("", name, holds)


@dataclass(frozen=True)
class Rules:
    """types: column to (type, nullable, required)."""

    types: dict[str, tuple[str, bool, bool]] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()
    unique: tuple[str, ...] = ()


def _text(value: Column, kind: str) -> Column:
    return (F.round(value, 6) if kind in ("double", "float") else value).cast("string")


def validate(df: DataFrame, rules: Rules) -> DataFrame:
    """(column_name, check_name, failures, lowest, highest): every rule, also those that hold.

    lowest and highest are the smallest and the largest value that fails, as text (floating ones with six decimals); null
    where nothing fails, and for rules of a whole row. All of it is one aggregation, whose result has a fixed size; the
    unique key takes another, and shows keys that occur more than once.
    """
    have, counts, fixed = dict(df.dtypes), [], []
    none = F.lit(None).cast("string")
    for c, (kind, nullable, required) in rules.types.items():
        if c not in have:
            fixed.append((c, "required", int(required)))
            continue
        fixed.append((c, f"type({kind})", int(have[c] != kind)))
        if not nullable:
            counts.append((c, "not_null", F.count_if(F.col(c).isNull()), none, none))
    for c in rules.checks:
        if not c.column or c.column in have:
            bad = F.when(~c.holds, F.col(c.column)) if c.column else None
            ends = (none, none) if bad is None else tuple(_text(f(bad), have[c.column]) for f in (F.min, F.max))
            counts.append((c.column, c.name, F.count_if(~c.holds), *ends))
    out = None
    if fixed:
        each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"), F.lit(n).cast("long").alias("failures"), none.alias("lowest"), none.alias("highest")) for c, k, n in fixed])
        out = df.sparkSession.range(1).select(F.inline(each))
    if counts:
        one = df.agg(*[x.alias(f"{n}{i}") for i, (_, _, *three) in enumerate(counts) for n, x in zip("clh", three, strict=True)])
        named = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"), F.col(f"c{i}").alias("failures"), F.col(f"l{i}").alias("lowest"), F.col(f"h{i}").alias("highest")) for i, (c, k, *_) in enumerate(counts)]))
        out = one.select(named) if out is None else out.union(one.select(named))
    if rules.unique:
        key = F.struct(*rules.unique)
        twice = duplicates(df, list(rules.unique)).agg(F.count(F.lit(1)).alias("failures"), F.to_json(F.min(key)).alias("lowest"), F.to_json(F.max(key)).alias("highest"))
        rows = twice.select(F.lit(", ".join(rules.unique)).alias("column_name"), F.lit("unique").alias("check_name"), "failures", "lowest", "highest")
        out = rows if out is None else out.union(rows)
    return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_or_raise(df: DataFrame, rules: Rules, name: str) -> DataFrame:
    bad = validate(df, rules).where("failures > 0").limit(50).collect()
    if bad:
        raise ValueError(f"{name}: " + "; ".join(f"{r.column_name} {r.check_name}: {r.failures} ({r.lowest} to {r.highest})" for r in bad))
    return df


def measure_rules() -> Rules:
    types = {"station_id": ("bigint", False, True), "component_id": ("bigint", False, True), "scope_id": ("bigint", False, True), "value": ("double", True, True), "ts_start": ("timestamp_ntz", False, True), "ts_end": ("timestamp_ntz", False, True), "quality_index": ("string", True, True)}
    hour = row_expr("one_hour", F.col("ts_end") == F.col("ts_start") + F.expr("interval 1 hour"))
    return Rules(types, (ge("station_id", 1), eq("scope_id", 2), ge("value", 0), le("value", MAX_CONCENTRATION), hour))


def station_rules() -> Rules:
    return Rules({}, (ge("station_id", 1), in_range("latitude", *LAT_RANGE), in_range("longitude", *LON_RANGE)), ("station_id",))


#: Plausible ranges of the weather metrics.
WEATHER_RANGES = {"temperature_c": (-40, 50), "humidity_pct": (0, 100), "wind_speed_ms": (0, 100), "wind_direction_deg": (0, 360), "pressure_msl_hpa": (850, 1100), "precipitation_mm": (0, float("inf"))}


def panel_rules() -> Rules:
    types = {"station_id": ("bigint", False, True), "timestamp": ("timestamp_ntz", False, True), "pm25": ("double", True, True), "no2": ("double", True, False)}
    ranges = tuple(in_range(c, *r) for c, r in WEATHER_RANGES.items())
    values = tuple(in_range(c, 0, MAX_CONCENTRATION) for c in ("pm25", "no2"))
    return Rules(types, (ge("station_id", 1), in_range("latitude", *LAT_RANGE), in_range("longitude", *LON_RANGE), *values, *ranges), ("station_id", "timestamp"))


def missing_percent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, pct): share of nulls in percent, two decimals."""
    one = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("pct")) for c in columns])).alias("r")).select("r.*")


def feature_report(features: DataFrame, edges: DataFrame, meta: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row: rows, stations, features, edges, stations without neighbours, and the share of each target that is missing."""
    targets = [c for c in features.columns if c.startswith("target_")]
    share = [F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias(f"{c}_missing_pct") for c in targets]
    one = features.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("stations"), F.lit(len(columns)).cast("long").alias("n_features"), *share)
    lone = meta.join(edges, key, "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    return one.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).crossJoin(F.broadcast(lone))
