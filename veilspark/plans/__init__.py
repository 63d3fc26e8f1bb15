"""Registered queries; importing the modules fills the registry."""

from veilspark.plans import evaluation, forms, gates, imaging, pages, payloads, planning, reports, streams, text  # noqa: F401
from veilspark.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
