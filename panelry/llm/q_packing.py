"""op7: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


#: Token ids are beyond SQL: the query is held against the tokenizer and a lower bound on bins in tests/llm.
QUERIES = {"op7_packing": op7_packing}
