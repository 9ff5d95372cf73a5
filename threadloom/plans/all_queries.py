"""Imports every query module so that the registry is complete."""

from threadloom.plans import explain_queries, ledger_queries, message_queries, relevance_queries, reply_queries, routing_queries, store_queries, streaming_queries, verdict_queries  # noqa: F401
from threadloom.plans.registry import CHECKS, QUERIES  # noqa: F401
