"""Registered queries, the views they read, and the SQL that checks them."""

from basketry.plans import lines, queries, stored
from basketry.plans.registry import QUERIES, SQL, register

__all__ = ["QUERIES", "SQL", "lines", "queries", "register", "stored"]
