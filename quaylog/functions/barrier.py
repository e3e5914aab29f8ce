"""A fence for the optimizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column) -> Column:
    """``c``, kept out of the filters and columns above it: Catalyst pushes a filter through a
    projection by copying the expressions it names, but not those that may differ by call."""
    return F.when(F.spark_partition_id() >= 0, c)
