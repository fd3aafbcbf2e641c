"""A training corpus in five stages, each over all that the one before it kept.

1. quality rules: documents that fail the base rules, or whose source is rejected as a whole, go.
2. n-gram Jaccard join: of each group of near-duplicates the document with the smallest doc_id stays.
3. secret scans: found spans are masked; no document is lost.
4. mixing: sources are brought to their target weights; a document comes out as many times as the mix takes it.
5. best-fit packing: everything that is left, as pieces placed in sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelry.llm.common import stored, table
from panelry.llm.host_rules import keep_good
from panelry.llm.mixing import mixed
from panelry.llm.ngram_join import keep_one
from panelry.llm.packing import pack
from panelry.llm.secret_scan import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their source's verdict reject go: null, empty and very short texts among them. Repeated rows share their fate."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays. Rows without doc_id or words stay; an empty table stays empty."""
    return keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are masked in place; rows and columns stay, null texts too."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come out as often as the mix takes them; null and empty texts, which have no words, never."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as pieces in sequences; a null or empty text is the end id alone. Other columns end here."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


#: Masked spans and token ids are beyond SQL: tests/llm hold the stages against plain versions.
ORACLE_SQL = None
