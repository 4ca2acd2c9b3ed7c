"""Exact places and running sums over all rows of a table, without a task that sees them all.

Rows are dealt by ranges of their order, whose bounds Spark samples, and written, so that each row's range
is fixed. Places count within ranges; each range adds what the ranges before it have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def placed(rows: DataFrame, order: list[Column], total: str | None = None) -> DataFrame:
    """rows with `place`, from 1, in the order, and `before`: the sum of the column total over all rows before (null counts as 0).

    The order must be total, or equal rows take their places in any way.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    amount = F.coalesce(F.col(total), F.lit(0)).cast("long") if total else F.lit(0).cast("long")
    # as many rows as there are ranges
    sums = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum(amount).alias("amount")).collect()
    starts, at, done = [], 0, 0
    for r in sorted(sums, key=lambda r: r["range"]):
        starts.append((r["range"], at, done))
        at, done = at + r["rows"], done + r["amount"]
    offsets = rows.sparkSession.createDataFrame(starts, "range int, rows_before long, sum_before long")
    inside = Window.partitionBy("range").orderBy(*order)
    out = ranged.join(F.broadcast(offsets), "range").withColumn("place", F.row_number().over(inside) + F.col("rows_before"))
    if total:
        running = F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("before", F.col("sum_before") + running - amount)
    return out.drop("range", "rows_before", "sum_before")
