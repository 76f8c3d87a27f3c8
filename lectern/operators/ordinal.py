"""Running ordinals that survive hot keys.

A window over all rows of a key puts them into one task. Here rows are numbered inside (key, coarse position) groups
and shifted by the sizes of the groups before, which are summed over the far smaller table of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offset(df: DataFrame, keys: list[str], coarse: str, order: list[str], weight: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the earlier rows of the same keys, in order of (coarse, order)."""
    grouped = [*keys, coarse]
    weighed = df.withColumn("__w", weight)
    totals = weighed.groupBy(*grouped).agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"__{c}") for c in grouped], F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*grouped).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = weighed.withColumn("__r", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in grouped]
    return placed.join(offsets, same).withColumn(out, F.col("__o") + F.col("__r")).drop("__w", "__r", "__o", *[f"__{c}" for c in grouped])


def occurrence(df: DataFrame, keys: list[str], coarse: str, order: list[str], out: str = "occ") -> DataFrame:
    """Adds the 0-based number of earlier rows with equal keys."""
    return running_offset(df, keys, coarse, order, F.lit(1).cast("long"), out)
