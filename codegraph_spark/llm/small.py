"""Joins with tables of groups, whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 50_000  # rows of some 200 bytes


def beside(table: DataFrame) -> DataFrame:
    """A written table of groups, broadcast where it is shown to be small, so that large groups stay where they are; else joined as usual."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_GROUPS else table
