"""Dense numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], number: str, materialize, name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``number``: how many rows (or how much ``weight``) come before the row in the ``order``.

    The order is a range-partitioned sort; numbers are counted inside a task
    and moved by the sizes of the tasks before it, one row per task. The
    sorted rows are written first: the tasks' numbers and sizes must not
    change when a lost one runs again.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    rows = materialize(df.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()), name)
    sizes = rows.groupBy("_task").agg(F.sum(one).alias("_size"))
    until = (Window.unboundedPreceding, -1)
    before = sizes.select("_task", F.coalesce(F.sum("_size").over(Window.orderBy("_task").rowsBetween(*until)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(one).over(Window.partitionBy("_task").orderBy(*order).rowsBetween(*until)), F.lit(0))
    return rows.join(F.broadcast(before), "_task").withColumn(number, F.col("_before") + inside).drop("_task", "_before")
