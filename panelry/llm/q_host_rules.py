"""op5: base rules and host verdicts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import stored, table
from .host_rules import judge, with_measures


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = judge(stored(with_measures(docs)), "source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_host_rules": op5_host_rules}
ORACLES = {
    "op5_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN
        word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS gram
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, (gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1)::INT AS twice FROM g),
c AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM t),
r AS (SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, count_if(base_failed) AS failures FROM b WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(failures) / sum(docs) AS mean, sum(docs) AS n, count(*) AS h FROM h),
v AS (SELECT any_value(mean) AS mean, any_value(mean * (1 - mean)) AS v, sum(docs * pow(failures / docs - mean, 2)) / sum(docs) AS seen,
             any_value((a.h - 1) / a.n) AS by_chance FROM h, a),
p AS (SELECT mean, greatest(1.0, least(1e6, v / greatest(seen - v * by_chance, 1e-9) - 1)) AS strength FROM v),
x AS (SELECT source, docs, strength, mean, (failures + mean * strength) / (docs + strength) AS rate FROM h, p),
j AS (SELECT source FROM x WHERE rate - 2 * sqrt(rate * (1 - rate) / (docs + strength + 1)) > greatest(0.5, mean))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (source IS NOT NULL AND source IN (SELECT source FROM j)) AS kept
FROM b
""",
}
