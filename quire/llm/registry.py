"""The queries of this subpackage and their SQL."""

from . import exact_dedup, language_id, line_dedup, lm_score, maxscore, mixing, ngram_join, packing, resampling, secret_scan, sharding, spelling, url_filter

_MODULES = (
    url_filter, language_id, packing, maxscore, ngram_join, mixing, secret_scan, lm_score, exact_dedup, sharding, resampling, line_dedup, spelling,
)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
