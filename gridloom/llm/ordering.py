"""Places of rows in a total order, found without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import materialize

#: Rows of one task that a place can hold; Spark's own row numbers leave as many bits.
_WITHIN = 1 << 33


def sorted_rows(df: DataFrame, *order: Column, label: str = "sorted") -> DataFrame:
    """The rows as a table in ranges of ``order``, with ``part`` (the range) and ``at`` (the place in it, ascending).

    Rows that are equal in ``order`` lie in one range, in any order.  ``df`` is read twice (once for
    the bounds of the ranges), so what is dear in it should be a table already.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % _WITHIN), label)


def ranked(rows: DataFrame, group: str) -> DataFrame:
    """Rows of :func:`sorted_rows` (ordered by ``group`` first) with ``pos``, from 0 in their group, and ``total``, the group's rows.

    One row for each group and range is enough to tell the places; a group of any size is spread over ranges.
    """
    counts = rows.groupBy(F.col(group).alias("_g"), F.col("part").alias("_part")).agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")  # as many rows as ranges
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_g", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    counts = materialize(counts, "ranges")
    own = rows.join(counts, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g")))
    return own.withColumn("pos", F.col("at") + F.col("_shift")).drop("_g", "_part", "_shift", "part", "at")
