"""Registry of every implemented operator: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

from churnlens.plans import q_accounts, q_audit, q_eval, q_models, q_profile

_MODULES = [q_accounts, q_eval, q_audit, q_models, q_profile]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
