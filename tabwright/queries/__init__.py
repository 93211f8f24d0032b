"""Every operator as a named query over the test tables, with SQL to check it by."""

from tabwright.queries import functions, inference, profiles, selection, tables, training  # noqa: F401
from tabwright.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
