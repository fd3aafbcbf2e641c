"""Mixing sources to target weights with hash-threshold histograms, by DataFrame operations alone.

Every document has a fixed hash. A source's budget is met by taking all documents below a hash threshold once more than
the others, so that a larger budget takes a superset (nested thresholds) and no source is ever sorted: token sums by
source and leading hash bits show the bucket in which the budget ends, and only that bucket is looked at again with the
next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, small, stored

#: Hex digits of the document's hash, and how many each refinement looks at.
DIGITS, STEP = 12, 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above `most` times its size.

    Sources in code point order (null last) take the weights in turn. With caps c and weights w the targets are
    min(c, x * w) with the one x that spends the budget: x is found where the sources, ordered by c / w, stop being
    capped. One row per source is sorted, never the documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % F.lit(len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    spent, used = F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)), F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - spent) / (F.sum("weight").over(every) - used)
    table = table.withColumn("level", level).withColumn("rank", F.row_number().over(by_ratio))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("rank", "level"))
    table = table.withColumn("x", F.min(free).over(every)["level"])
    target = F.when(F.col("x").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("x") * F.col("weight")))
    return table.select("source", "source_size", target.alias("target"))


def _open_bucket(rows: DataFrame, budgets: DataFrame, level: int, n_sources: int) -> DataFrame:
    """(source, left, low, high, below): each source's bucket in which `left` runs out, and the words below it."""
    low = F.substring("hex", level * STEP + 1, STEP)
    sums = rows.groupBy("source", low.alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = sums.withColumn("upto", upto)
    at = budgets.select(F.col("source").alias("s"), "left", "prefix")
    joined = sums.join(small(at, n_sources), F.col("source").eqNullSafe(F.col("s")), "inner")
    reach = joined.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "words", "upto", "left", "prefix")).alias("m"))
    return reach.select("source", F.concat("m.prefix", "m.bucket").alias("prefix"), (F.col("m.left") - (F.col("m.upto") - F.col("m.words"))).alias("left"), F.col("m.words").alias("words"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, threshold, closed) from (source, size, hex) and the targets.

    A document is taken epochs times, and once more if its hash is below the threshold, or at it where `closed`: the
    documents at the threshold are added if the source's words then come nearer to the target.
    """
    n = goals.count()
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = goals.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    budgets = plan.select("source", "left", F.lit("").alias("prefix"))
    part = rows
    for level in range(DIGITS // STEP):
        budgets = stored(_open_bucket(part, budgets, level, n))
        at = budgets.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.substring("hex", 1, (level + 1) * STEP) == F.col("p"))
        part = part.join(small(at, n), inside, "left_semi")
    ends = budgets.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"), (F.col("words") - F.col("left") < F.col("left")).alias("closed"))
    out = plan.join(small(ends, n), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("source", "source_size", "target", "epochs", "threshold", F.coalesce("closed", F.lit(False)).alias("closed"))


def hash_digits(key: str = "doc_id") -> Column:
    return F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, DIGITS)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hex): the narrow rows that thresholds are found on, written once."""
    return stored(docs.select("doc_id", "source", n_words().alias("size"), hash_digits().alias("hex")))


def source_ends(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source_size, target, epochs, threshold, closed. See thresholds().

    A null source is a source of its own. A source without words has target 0, and none of its rows is taken.
    """
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    return stored(thresholds(rows.where("size > 0"), goals))


def with_copies(rows: DataFrame, ends: DataFrame, hex_digits: str = "hex", *, name: str = "copies") -> DataFrame:
    """Adds source_size, target and copies: how often the mix takes each row. Rows with equal doc_id share a decision.

    One row per source is joined; nothing is shuffled while sources are few, whatever the size of the hot ones.
    """
    side = ends.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "threshold", "closed")
    joined = rows.join(small(side, ends.count()), F.col("source").eqNullSafe(F.col("_s")), "inner")
    below = (F.col(hex_digits) < F.col("threshold")) | ((F.col(hex_digits) == F.col("threshold")) & F.col("closed"))
    more = F.when(F.col("threshold").isNotNull() & below, F.lit(1)).otherwise(F.lit(0))
    return joined.select(*[rows[c] for c in rows.columns], "source_size", "target", (F.col("epochs") + more).cast("int").alias(name))


def decide(rows: DataFrame, **options) -> DataFrame:
    """The rows of keyed() with source_size, target and copies.

    A null or empty text has size 0 and is never taken; a null source is a source; repeated rows are taken alike; an empty
    table gives no rows.
    """
    return with_copies(rows, source_ends(rows, **options))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: absent, once, or as many rows as copies; columns stay as they are.

    Texts are read twice, to size them and to copy them, and never shuffled. Extra columns may have any name. Null and empty
    texts go, repeated rows are taken alike, and an empty table stays empty.
    """
    ends = source_ends(keyed(docs), **options)
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source")}
    renamed = docs.withColumnsRenamed(place).withColumn("hex", hash_digits())
    copies = with_copies(renamed, ends)
    repeated = copies.where("copies > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(place.get(c, c)).alias(c) for c in docs.columns])
