"""All queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from tabulon.llm import bpe, exact_dedup, line_dedup, maxent, mixing, ordinal, quality_rules, revisits, simhash, toxicity

MODULES = [revisits, mixing, exact_dedup, quality_rules, bpe, simhash, line_dedup, ordinal, toxicity, maxent]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
