"""All registered queries of the library, by importing the modules that register them."""

from stateroll.plans import operations, reductions, reports, scalars  # noqa: F401
from stateroll.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
