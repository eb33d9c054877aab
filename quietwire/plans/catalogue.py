"""Imports every query module so that the registry is complete."""

from quietwire.plans import (dns_queries, encrypted_queries, evaluation_queries, event_queries, feature_queries, flow_queries, message_queries, model_queries,
                             source_queries, stream_queries, window_queries)  # noqa: F401
from quietwire.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
