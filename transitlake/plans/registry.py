"""Collects the registered queries and their oracle SQL from every plan module."""

from __future__ import annotations

import importlib

MODULES = [
    "transitlake.plans.catalog_queries",
    "transitlake.plans.report_queries",
    "transitlake.plans.sampling_queries",
    "transitlake.plans.stats_queries",
    "transitlake.plans.fitted_queries",
    "transitlake.plans.metrics_queries",
    "transitlake.plans.validate_queries",
    "transitlake.plans.model_queries", "transitlake.plans.oversample_queries",
    "transitlake.plans.extra_queries",
    "transitlake.plans.match_queries",
    "transitlake.plans.store_queries",
]


def _load():
    return [importlib.import_module(m) for m in MODULES]


def all_queries() -> dict:
    out: dict = {}
    for m in _load():
        for k, v in m.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query name {k}")
            out[k] = v
    return out


def portable_round(sql: str, digits: int = 6) -> str:
    """Rewrite ``round(<expr>, 6)`` as ``round((<expr>) * 1e6) / 1e6`` so the
    oracle rounds exactly like the Spark side (see functions.expr.r6)."""
    key, out, i = "round(", [], 0
    low = sql.lower()
    while True:
        j = low.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        # matching close paren of this round(
        depth, k = 0, j + len(key) - 1
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = sql[j + len(key):k]
        tail = f", {digits}"
        if inner.rstrip().endswith(tail):
            arg = portable_round(inner.rstrip()[: -len(tail)], digits)
            out.append(sql[i:j])
            out.append(f"(round(({arg}) * 1e{digits}) / 1e{digits})")
        else:
            out.append(sql[i:j + len(key)])
            out.append(portable_round(inner, digits))
            out.append(")")
        i = k + 1


def all_oracle_sql() -> dict:
    out: dict = {}
    for m in _load():
        out.update({k: portable_round(v) for k, v in m.ORACLE.items()})
    return out
