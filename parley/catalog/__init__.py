"""The registered queries, each with the SQL it is checked against where SQL can say it."""

import importlib

from parley.catalog.registry import ORACLES, QUERIES

# Importing a module registers its queries.
for _name in ("corpora", "storage", "ordering", "vocabulary", "statistics", "masks", "training", "metrics"):
    importlib.import_module(f"parley.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
