"""The registered queries of this subpackage, gathered from its modules. All are imported here, so that one that fails does so at once."""

from __future__ import annotations

from quarrykit.llm import archive, decontaminate, language, main_text, mixing, near_dup, neighbours, phrases, quality, sharding, toxicity, url_filter, whitening

MODULES = (decontaminate, main_text, near_dup, sharding, language, archive, neighbours, url_filter, toxicity, mixing, phrases, quality, whitening)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
