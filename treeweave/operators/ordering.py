"""Row numbers and running sums over groups of any size.

A window over a whole group sorts that group in one task. Here rows are range-partitioned first, the slice number is
pinned in the shared folder, and each slice is numbered on its own; slice totals, at most one row per slice and group,
give the offsets. A group that holds a third of all rows is spread over a third of the slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treeweave.session import pin


def with_running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    number: str | None = None,
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Add `number` (1, 2, ... in `order`) and, per entry of `sums` (new column -> summed column), the running sum.

    Pass only the columns needed: they are written once. `order` must be unique within a group.
    """
    sums = sums or {}
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    sliced = pin(df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()))

    totals = sliced.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()]
    )
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums],
    )
    within = W.partitionBy(*by, "_slice").orderBy(*order)
    joined = sliced.join(offsets, [*by, "_slice"])
    columns = [F.col(c) for c in df.columns]
    if number:
        columns.append((F.row_number().over(within) + F.col("_rows")).alias(number))
    for name, c in sums.items():
        so_far = F.sum(c).over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
        columns.append((so_far + F.col(f"_{name}")).alias(name))
    return joined.select(*columns)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    return with_running(df, by, order, number=name)
