"""Paired-image analytics as Spark DataFrames.

Every operator takes and returns DataFrames with explicit grouping columns.
A frame is a (sparse) pixel table; a missing pixel row means the value 0.
"""

from .session import local_session, pin, work_dir

__all__ = ["local_session", "pin", "work_dir"]
