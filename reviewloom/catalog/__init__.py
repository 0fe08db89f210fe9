"""Registered queries and the SQL that must give the same rows."""

from importlib import import_module

MODULES = ("text", "inspection", "splitting", "features", "scoring", "reports", "requests", "sources", "training", "small_fits")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), attribute).items():
            if key in merged:
                raise ValueError(f"query {key} is registered twice")
            merged[key] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
