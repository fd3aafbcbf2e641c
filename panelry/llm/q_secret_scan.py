"""op6: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .secret_scan import digest


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


#: Spans of matches are beyond SQL: the query is held against a plain scan in tests/llm.
QUERIES = {"op6_secret_scan": op6_secret_scan}
