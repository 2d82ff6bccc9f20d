"""Registered queries: each runs a library operator over the whole given tables."""

from .base import ORACLE, QUERIES, ROWS  # noqa: F401
from . import (  # noqa: F401
    catalogue, pixels, histograms, masks, neighbourhoods, registration, scales, diagnostics, parameters,
)
