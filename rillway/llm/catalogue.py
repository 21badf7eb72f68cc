"""All queries of the subpackage and their SQL oracles."""

from rillway.llm import queries

QUERIES = queries.QUERIES
ORACLE = queries.ORACLE
