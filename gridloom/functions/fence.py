"""A fence that keeps filters above a long chain of computed columns.

Spark copies a filter through every projection below it.  Through a chain in
which each step uses the one before several times, the copied condition grows
exponentially.  A value that depends on the partition number is left where it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fence(c: Column) -> Column:
    """The same value, not to be moved; the partition number is never negative."""
    return F.when(F.spark_partition_id() >= 0, c)
