"""Named queries over the test tables, and their SQL twins."""

from gossamer.plans import analytics_queries, engine_queries, skew_queries  # noqa: F401
from gossamer.plans.registry import QUERIES, SQL  # noqa: F401
