"""Every registered query with its SQL."""

from weftgraph.queries import clustering, graphs, layouts, models, more, products  # noqa: F401
from weftgraph.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
