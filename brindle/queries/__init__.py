"""All registered queries of the engine."""

from . import analytic, further, more, relational, scalars
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytic", "further", "more", "relational", "scalars"]
