"""op12: the prefix trie of all conversations, rebuilt so that conversations of a hundred share their first turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table
from .prefix_trie import prefix_trie, turns_in_order

#: So many ids share the first turns of one, and so many turns less one are shared at most.
GROUP, MOST = 100, 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of all conversations: the first h turns of conversation c - c % 100, then those after c's own first h.

    turns: (conv_id, pos, t1, t2, chars). h = crc32(c) % 6. The base may have fewer turns, or be absent.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = stored(turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", base))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < MOST - 1)).withColumnRenamed("conv_id", "of")
    n = heads.groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    shared = convs.join(heads, (F.col("base") == F.col("of")) & (F.col("pos") < F.col("h"))).select("conv_id", "pos", "t1", "t2", "chars")
    taken = convs.join(n, F.col("base") == F.col("of"), "left").select(F.col("conv_id").alias("c"), "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    own = turns.where(F.col("pos") >= h).join(small(taken, convs.count()), F.col("conv_id") == F.col("c"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "chars")
    return shared.union(own), convs.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(turns_in_order(table(spark, sf_dir, "conversations")))
    return prefix_trie(*rebuilt(turns)).drop("id")


#: crc32 is not in DuckDB: tests/llm hold the query to a plain version.
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
