"""Operators for training-data corpora. Nothing else in docmill imports this package."""

from docmill.llm.registry import llm_oracle_sql, llm_queries

__all__ = ["llm_oracle_sql", "llm_queries"]
