"""op8: how much of each document the mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import decide, keyed


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide(keyed(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, substr(md5(doc_id::VARCHAR), 1, 12) AS hex,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, row_number() OVER o AS pos,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - spent) / (sum(weight) OVER () - used) AS level FROM c),
x AS (SELECT level FROM l WHERE cap > level * weight ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM x) * weight, cap)) AS target FROM w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
b AS (SELECT source, hex, sum(size) AS words,
             sum(sum(size)) OVER (PARTITION BY source ORDER BY hex) AS upto FROM d WHERE size > 0 GROUP BY source, hex),
m AS (SELECT b.source, b.hex, b.words, e.target - e.epochs * e.source_size - (b.upto - b.words) AS rest
      FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source),
h AS (SELECT source, hex FROM m WHERE rest >= words OR (rest > 0 AND words - rest < rest))
SELECT d.doc_id, d.size, e.source_size, round(e.target, 6) AS target,
       (d.size * (e.epochs + CASE WHEN h.hex IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.hex = h.hex
""",
}
