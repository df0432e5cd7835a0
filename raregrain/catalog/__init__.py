"""Registered queries and their independent SQL checks."""
from importlib import import_module

MODULES = ["basics", "evaluation", "balance", "nearest", "anomalies", "models"]


def load():
    for m in MODULES:
        import_module(f"raregrain.catalog.{m}")
    from raregrain.catalog.fixtures import ORACLES, QUERIES
    return QUERIES, ORACLES
