"""Registered queries."""

from treeweave.plans import file_queries, history_queries, request_queries, stream_queries, text_queries  # noqa: F401
from treeweave.plans.registry import ORACLES, QUERIES  # noqa: F401
