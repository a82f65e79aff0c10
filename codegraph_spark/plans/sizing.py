"""Partitions by rows instead of by the session's setting.

A task that sorts or aggregates holds a share of the rows that grows with the table if the number of shuffle partitions is fixed, and compressed
sizes tell little about short strings. Large steps are dealt out so that a task meets about ``ROWS`` rows, whatever the table's size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

ROWS = 1_000_000


def parts(*tables: DataFrame) -> int:
    """Partitions for a step over the rows of all ``tables``: at least one per core."""
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    return max(cores, math.ceil(sum(t.count() for t in tables) / ROWS))
