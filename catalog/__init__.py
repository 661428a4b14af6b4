"""Registered queries: every operator run over the given tables, with its SQL where SQL can say it."""

from . import cells, daily, hexagons, lists, models, pages, rules, runs, tables

QUERIES = {}
ORACLES = {}
for _module in (daily, rules, lists, tables, cells, hexagons, pages, models, runs):
    QUERIES.update(_module.registry.queries)
    ORACLES.update(_module.registry.oracles)
