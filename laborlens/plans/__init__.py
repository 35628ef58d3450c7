"""Registered queries."""


def all_queries():
    import importlib

    for part in ("match", "serve", "record", "text", "flow"):
        importlib.import_module(f"laborlens.plans.{part}_queries")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
