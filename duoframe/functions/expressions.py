"""Helpers to build column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, so that nested products stay small expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
