"""Registered queries. Importing a module here registers its queries."""

from . import (  # noqa: F401
    aggregates, answers, columns, features, layers, learning, profiling, quality, runs, sequences, splits, storage, texts,
)
from .registry import QUERIES, oracle_sql, queries  # noqa: F401
