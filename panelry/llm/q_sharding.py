"""op3: the shards of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sharding import shard_table


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_table(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_sharding": op3_sharding}
#: No crc32 in DuckDB: the query is held against a row-by-row version in tests/llm.
ORACLES: dict = {}
