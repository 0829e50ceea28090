"""All registered queries of the library."""

from drawgraph.plans import dataset_queries, graph_queries, io_queries, merge_queries, scalar_queries, validate_queries  # noqa: F401
from drawgraph.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
