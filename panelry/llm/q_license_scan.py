"""op13: license names and notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .license_scan import scan_licenses


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


#: Merged diagonals of notices are held to a plain version in tests/llm, and the columns of the base to SQL.
QUERIES = {"op13_license_scan": op13_license_scan}
