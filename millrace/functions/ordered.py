"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.folders import written


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums: new column by summed column.

    Rows are range-partitioned by ``order``; each partition sums its own rows
    and starts at the totals of those before it, of which there is one row a
    partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that both reads see the same ranges, also after an executor was lost
    placed = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__sum_{c}") for c in totals.values()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *[F.coalesce(F.sum(f"__sum_{c}").over(ahead), F.lit(0)).alias(f"__before_{c}") for c in totals.values()])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "__part")
    for name, c in totals.items():
        joined = joined.withColumn(name, F.sum(c).over(own) + F.col(f"__before_{c}"))
    return joined.drop("__part", *[f"__before_{c}" for c in totals.values()])
