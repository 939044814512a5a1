"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from . import alignment, decontaminate, html_text, mixing, near_dedup, quality_rules, secrets, substring_dedup, token_counts, toxicity, url_filters, warc, whitening

_MODULES = [near_dedup, token_counts, decontaminate, warc, substring_dedup, secrets, html_text, toxicity, quality_rules, mixing, alignment, whitening, url_filters]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
