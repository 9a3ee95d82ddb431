"""Running totals that do not pull a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column, name: str = "before") -> DataFrame:
    """Adds the sum of value over the rows of the same keys that come before.

    bucket must not fall as order grows. Rows are summed inside (keys, bucket), and only one row a bucket goes through the window over
    the keys, so that a key with a third of all rows is spread over many tasks. order must be unique in its keys.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    near = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(near), F.lit(0)))
    return out.select(*df.columns, name)
