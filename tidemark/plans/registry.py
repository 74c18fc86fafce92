"""All queries of the library by name, with their SQL counterparts."""

from __future__ import annotations

import functools
import importlib

from tidemark.session import ship

FLAGSHIP = "rescue_priority_rank"
MODULES = ["ranking_queries", "metric_queries", "grid_queries", "graph_queries", "text_queries", "spatial_queries", "damage_queries", "scene_queries", "layer_queries"]


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES, ORACLE_SQL = {}, {}
for _name in MODULES:
    _module = importlib.import_module(f"tidemark.plans.{_name}")
    QUERIES |= {k: _shipped(q) for k, q in _module.QUERIES.items()}
    ORACLE_SQL |= _module.SQL
