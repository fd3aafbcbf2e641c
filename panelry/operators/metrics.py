"""Regression and spike metrics, average precision, breakdowns, and comparison on common rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .align import strict_align
from .quantiles import exact_quantiles
from .split import require_empty


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2, mape_pct (over |y| >= 1) and mape_excluded, per group; one aggregation.

    A constant truth has r2 1 if it is met, else 0.
    """
    e = F.col(y) - F.col(p)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(F.lit(1))
    usable = F.abs(y) >= 1
    agg = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0).alias("r2"),
        (F.avg(F.when(usable, F.abs(e / F.col(y)))) * 100).alias("mape_pct"),
        F.count_if(~usable).alias("mape_excluded"),
    )
    return agg


def spike_threshold(train: DataFrame, y: str, percent: float = 0.9) -> DataFrame:
    """One row: the exact percentile of the training values."""
    return exact_quantiles(train, {"threshold": (y, percent)})


def spike_classification(df: DataFrame, y: str, p: str, threshold: Column) -> DataFrame:
    """actual, predicted, precision, recall, f1; a division by zero gives 0."""
    a, b = F.col(y) >= threshold, F.col(p) >= threshold
    c = df.agg(F.count_if(a).alias("actual"), F.count_if(b).alias("predicted"), F.count_if(a & b).alias("hits"))
    share = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), n), F.lit(0.0))
    return c.select("actual", "predicted", share("hits", F.col("predicted")).alias("precision"), share("hits", F.col("actual")).alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("actual") + F.col("predicted")), F.lit(0.0)).alias("f1"))


def average_precision(df: DataFrame, truth: Column, score: str, buckets: int = 4096) -> DataFrame:
    """Sum over distinct scores, falling, of precision times the gain in recall; exact, without one global window.

    Distinct scores are counted first. They fall into ranges by approximate quantiles; running sums inside a range start
    from the sums of the ranges above, so no task orders all scores.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(truth).alias("tp"), F.count(F.lit(1)).alias("n"))
    edges = by.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)] if buckets > 1 else [0.5], 10_000).alias("edges"))
    edges = edges.select(F.array_distinct(F.array_sort("edges")).alias("edges"))
    part = by.crossJoin(F.broadcast(edges)).select("s", "tp", "n", F.size(F.filter("edges", lambda x: x > F.col("s"))).alias("part")) if buckets > 1 else by.withColumn("part", F.lit(0))
    sums = part.groupBy("part").agg(F.sum("tp").alias("ptp"), F.sum("n").alias("pn"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    sums = sums.select("part", F.coalesce(F.sum("ptp").over(ahead), F.lit(0)).alias("tp0"), F.coalesce(F.sum("pn").over(ahead), F.lit(0)).alias("n0"), F.sum("ptp").over(whole).alias("all_tp"))
    down = W.partitionBy("part").orderBy(F.col("s").desc())
    rows = part.withColumn("ctp", F.sum("tp").over(down)).withColumn("cn", F.sum("n").over(down)).join(F.broadcast(sums), "part")
    gain = F.col("tp") / F.col("all_tp") * (F.col("ctp") + F.col("tp0")) / (F.col("cn") + F.col("n0"))
    return rows.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))


def breakdown(df: DataFrame, by: list[str], extra: dict[str, Column] | None = None, error: str = "abs_error") -> DataFrame:
    """mae and n of each group, and what else is asked for."""
    return df.groupBy(*by).agg(F.avg(error).alias("mae"), F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (extra or {}).items()])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def score_models(keys_df: DataFrame, truth: DataFrame, predictions: DataFrame, keys: list[str], y: str = "actual") -> DataFrame:
    """Metrics of each model on identical rows; predictions are long: model, keys, prediction. A gap raises."""
    models = predictions.select("model").distinct()
    wanted = models.crossJoin(keys_df.select(*keys))
    rows = strict_align(predictions, wanted, ["model", *keys]).join(truth.select(*keys, y), keys)
    return regression_metrics(rows, y, "prediction", ["model"])


def reproduction_gate(scores: DataFrame, reported: DataFrame, on: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Each model's r2 against the reported one: delta, and failed where it exceeds the tolerance of its kind."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in tolerance.items() for x in kv]), F.col("kind"))
    joined = scores.join(reported, on)
    return joined.withColumn("delta", F.col("r2") - F.col("reported_r2")).withColumn("failed", F.abs("delta") > limit)


def model_comparison(scores: DataFrame, target: str, values: list[str], metrics: list[str]) -> DataFrame:
    """One row per model, metrics of all targets side by side."""
    cols = [F.max(F.when(F.col(target) == v, F.col(m))).alias(f"{m}_{v}") for v in values for m in metrics]
    return scores.groupBy("model").agg(*cols)


__all__ = ["average_precision", "breakdown", "model_comparison", "regression_metrics", "reproduction_gate", "require_empty", "score_models", "spike_classification", "spike_threshold", "top_k"]
