"""All queries of the training-data operators and their DuckDB twins."""

from . import bpe, centroids, chat, decontaminate, host_rules, language, lm_score, phrases, quality, secrets, simhash, token_counts, warc

MODULES = [bpe, host_rules, secrets, decontaminate, language, token_counts, simhash, warc, quality, lm_score, centroids, chat, phrases]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
