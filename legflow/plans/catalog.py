"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from legflow.plans import board_queries, dim_queries, io_queries, leg_queries, problems, relational_queries, stage_queries

QUERIES = {**problems.QUERIES, **leg_queries.QUERIES, **board_queries.QUERIES, **relational_queries.QUERIES, **stage_queries.QUERIES, **dim_queries.QUERIES, **io_queries.QUERIES}
SQL = {**problems.SQL, **leg_queries.SQL, **board_queries.SQL, **relational_queries.SQL, **stage_queries.SQL, **dim_queries.SQL, **io_queries.SQL}
