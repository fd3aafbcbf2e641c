"""op10: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_extract import extract


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: A trained model is beyond SQL: tests/llm hold it to brute-force marginals and to pages with known text.
QUERIES = {"op10_html_extract": op10_html_extract}
