"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, html_text, line_dedup, minhash, packing, quality, sharding, token_files, toxicity, url_filter

MODULES = (sharding, token_files, packing, url_filter, html_text, quality, toxicity, minhash, line_dedup, decontamination)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.SQL.items()}
