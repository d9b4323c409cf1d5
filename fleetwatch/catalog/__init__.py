"""Registered queries: the operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from .registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    from . import column_queries, detector_queries, episode_queries, message_queries, storage_queries  # noqa: F401

    return REGISTRY
