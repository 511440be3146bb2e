"""Imports every query module so the registry is complete."""

from pricelens.plans import (q_agg, q_features, q_ingest, q_lookup, q_ml, q_model, q_scenario,  # noqa: F401
                             q_slice, q_stream, q_validate, q_window)
from pricelens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
