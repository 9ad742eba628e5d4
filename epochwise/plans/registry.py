"""Importing this module registers every query."""

from epochwise.plans import (  # noqa: F401
    projections,
    sequences,
    readouts,
    statistics,
    allocations,
    traces,
    reshapes,
    storage,
    modelling,
    live,
)
from epochwise.plans.base import ORACLES, QUERIES  # noqa: F401
