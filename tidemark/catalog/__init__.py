"""All registered queries."""

import importlib

from tidemark.catalog.base import QUERIES

MODULES = ("sources", "filters", "joins", "aggregates", "wallets", "series", "scores", "bets", "agents", "ranks",
           "scalars", "streams")

for _m in MODULES:
    importlib.import_module(f"tidemark.catalog.{_m}")

__all__ = ["QUERIES"]
