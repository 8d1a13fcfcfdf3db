"""Queries over the provided tables, each with the SQL it must agree with."""

from . import line_physics, scores_and_pairs, selection, tables_and_joins, vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
