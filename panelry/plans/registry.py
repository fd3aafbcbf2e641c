"""All registered queries of the panel engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir); sql is its equivalent over the same tables, where there is one."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from panelry.plans import q_clean, q_evaluate, q_panel, q_reports, q_sources  # noqa: E402, F401
