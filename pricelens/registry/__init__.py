"""Named queries over the driver tables together with their reference SQL."""
from __future__ import annotations

from importlib import import_module

MODULES = ("daily", "study", "ticks", "events", "whatif", "sources", "streams")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f".{name}", __name__), attribute).items():
            if key in out:
                raise ValueError(f"duplicate query {key}")
            out[key] = value
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
