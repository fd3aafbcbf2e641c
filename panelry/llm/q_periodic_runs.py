"""op11: periodic runs of all documents, some of which are made periodic by a fixed rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_texts, table
from .periodic_runs import periodic_runs


def echoed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id), every tenth text repeats a stretch of itself from some word on.

    Where h % 10 = 0 the words from a = g % n on, g = h // 10, repeat the first p of them, p = 1 + (n - a) // (3 + g % 8).
    Rows without doc_id and texts without words stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                h = zlib.crc32(str(doc).encode())
                words = (texts[i] or "").encode().split() if doc is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    part = words[a : a + p]
                    texts[i] = b" ".join(words[:a] + (part * ((n - a) // p + 1))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return over_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Runs come by start, then period."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.reduce(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(echoed(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
        "n_words",
    )


#: crc32 is not in DuckDB: tests/llm hold the query to a plain version.
QUERIES = {"op11_periodic_runs": op11_periodic_runs}
