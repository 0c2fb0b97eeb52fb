"""Every registered query (``QUERIES``) with its DuckDB twin (``ORACLES``)."""

from __future__ import annotations

from quirespark.plans import costs, documents, folds, increments, joins, labels, orders, progress, quality, saves, services, shelf, text, views, windows

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (progress, text, joins, costs, windows, folds, quality, views, labels, orders, documents, increments, saves, shelf, services):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
