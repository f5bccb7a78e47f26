"""All registered queries; importing the modules registers them."""

from placestat.plans import queries_core, queries_models, queries_planning, queries_spatial, queries_text  # noqa: F401
from placestat.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
