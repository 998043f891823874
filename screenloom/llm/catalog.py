"""Registered queries of the training-data operators and their SQL."""
from screenloom.llm import queries
from screenloom.llm.sql import ORACLES  # noqa: F401

QUERIES = dict(queries.QUERIES)
