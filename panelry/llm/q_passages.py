"""op2: what all documents lose to passages of earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .passages import repeated_passages


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op2_passages": op2_passages}
ORACLES = {
    "op2_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM g),
u AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
c AS (SELECT u.doc_id, u.i, u.word, coalesce(max(m.again::INT) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM u LEFT JOIN m ON u.doc_id = m.doc_id AND u.i = m.i),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
}
