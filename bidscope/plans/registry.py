"""All registered queries and their SQL oracles."""
from __future__ import annotations

from . import (extract_queries, misc_queries, oracle_extract, oracle_misc,  # noqa: F401
               oracle_retrieve, retrieve_queries)
from .oracle_sql import SQL
from .queries import FLAGSHIP, QUERIES

__all__ = ["QUERIES", "SQL", "FLAGSHIP"]
