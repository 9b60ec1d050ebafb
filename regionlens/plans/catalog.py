"""All registered queries: importing this module registers every query module in order."""

from . import registry
from . import graph_queries  # noqa: F401
from . import ml_queries  # noqa: F401
from . import misc_queries  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
