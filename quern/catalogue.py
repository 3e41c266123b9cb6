"""All queries of the library by name, and the SQL that each is checked against."""

from quern.plans import kv, search, service  # noqa: F401
from quern.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
