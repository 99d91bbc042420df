"""The registered queries of the library's own operators, with SQL for them."""

from logspark.plans import inventory_queries, line_queries, metric_queries, source_queries, stream_queries  # noqa: F401
from logspark.plans.registry import QUERIES, SQL  # noqa: F401
