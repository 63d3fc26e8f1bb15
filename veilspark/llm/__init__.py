"""Operators for preparing training text, and their registered queries."""

from veilspark.llm import op1_queries, op2_queries, op3_queries, op4_queries, op5_queries, op6_queries, op7_queries, op8_queries, op9_queries, op10_queries, op11_queries, op12_queries, op13_queries  # noqa: F401
from veilspark.llm.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
