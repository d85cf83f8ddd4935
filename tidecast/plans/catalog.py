"""Loads every checked-query module and exposes the registry."""

from __future__ import annotations

from . import q_bundles, q_clean, q_eda, q_forecast, q_io, q_ml, q_models, q_quality, q_recommend, q_series, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
