"""Explicit schemas of tables that are made from literals or text."""

PARAM_REGISTRY = (
    "ord int, name string, default string, type string, abbrev string, "
    "stage int, grp string, description string"
)
RUN_LOG = "ts timestamp, seq bigint, section string, line string"
