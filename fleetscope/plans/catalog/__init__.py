"""Queries of every operator over the given tables, each with the SQL that must return the same rows."""

from fleetscope.plans.catalog import commerce, corpus, dialogue, docs, manifests, risk, stream, tree, web
from fleetscope.plans.catalog.base import Query

CATALOGUE: dict[str, Query] = {}
for _module in (risk, corpus, tree, web, dialogue, stream, commerce, manifests, docs):
    for _name, _query in _module.QUERIES.items():
        if _name in CATALOGUE:
            raise ValueError(f"two queries are called {_name}")
        CATALOGUE[_name] = _query
