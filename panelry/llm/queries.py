"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import q_bm25, q_factorization, q_host_rules, q_html_extract, q_license_scan, q_mixing, q_ngram_join, q_packing, q_passages, q_periodic_runs, q_prefix_trie, q_secret_scan, q_sharding

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (q_bm25, q_passages, q_sharding, q_factorization, q_host_rules, q_secret_scan, q_packing, q_mixing, q_ngram_join, q_html_extract, q_periodic_runs, q_prefix_trie, q_license_scan):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
