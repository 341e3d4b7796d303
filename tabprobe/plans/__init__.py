"""Named queries over the fixture tables, each with an optional SQL twin."""

from tabprobe.plans import (chart_queries, clean_queries, correlation_queries,  # noqa: F401
                            edge_queries, model_queries, profile_queries, source_queries, stats_queries)
from tabprobe.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
