"""The operators run over the shared test tables, each with the SQL that must agree."""

from codegraph_spark.workloads.base import ORACLES, QUERIES
from codegraph_spark.workloads import indexing, retrieval, relations, analytics  # noqa: F401  (registers the queries)

__all__ = ["QUERIES", "ORACLES"]
