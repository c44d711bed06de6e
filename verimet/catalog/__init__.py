"""Registered queries: the operators run over the driver tables, each with its SQL twin."""

from __future__ import annotations

from verimet.catalog import (  # noqa: F401  (importing registers the queries)
    alignment, learning, observations, places, scalars, storage, streams, upkeep, verification, windowing,
)
from verimet.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
