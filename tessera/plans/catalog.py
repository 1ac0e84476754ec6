"""Imports every query module and exposes the filled registry."""

from __future__ import annotations

from tessera.plans import (  # noqa: F401
    index_queries,
    robustness_queries,
    sampling_queries,
    split_queries,
    telemetry_queries,
    storage_queries,
    learning_queries,
    streaming_queries,
)
from tessera.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
