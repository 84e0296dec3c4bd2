"""All registered queries; the subpackage for text corpora adds its own where it is present."""

from __future__ import annotations

from . import design_queries, graph_queries, problems

QUERIES = {**problems.QUERIES, **graph_queries.QUERIES, **design_queries.QUERIES}
SQL = {**problems.SQL, **graph_queries.SQL, **design_queries.SQL}
