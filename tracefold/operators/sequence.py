"""Skew-safe running counters and sums.

A plain ``row_number() OVER (PARTITION BY run ORDER BY seq)`` puts a whole run
into one task; with one run holding a third of all rows that task is the job.
Here the order is cut into buckets that are monotone in the order key
(``bucket = seq div width``): a small per-(key, bucket) total is computed with
partial aggregation, prefix offsets are taken over those totals, and the final
window runs per (key, bucket).  The result is exact; the largest task holds one
bucket, not one key. A row without a place in the order (NULL bucket) raises:
it would otherwise be lost in the join with the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(bucket: Column) -> Column:
    lost = F.raise_error(F.lit("a running counter needs an order value (seq) on every row")).cast("long")
    return F.when(bucket.isNotNull(), bucket.cast("long")).otherwise(lost)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column,
                out: str, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``keys`` up to this row (in ``order``).

    ``bucket`` must be non-decreasing in ``order`` within a key.  ``inclusive=False``
    gives the sum over strictly earlier rows.
    """
    b = "__bucket"
    v = "__value"
    d = df.withColumn(b, _placed(bucket)).withColumn(v, value)
    totals = d.groupBy(*keys, b).agg(F.sum(v).alias("__bucket_total"))
    prior = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, F.coalesce(F.sum("__bucket_total").over(prior), F.lit(0)).alias("__offset"))
    frame_end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    return (d.join(offsets, [*keys, b], "inner")
            .withColumn(out, F.col("__offset") + F.coalesce(F.sum(v).over(inner), F.lit(0)))
            .drop(b, v, "__offset"))


def running_index(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str,
                  base: int = 0) -> DataFrame:
    """Add ``out`` = position of the row inside its key, counted from ``base``, in ``order``."""
    r = running_sum(df, keys, order, F.lit(1).cast("long"), bucket, "__pos", inclusive=True)
    return r.withColumn(out, F.col("__pos") - 1 + base).drop("__pos")


def lag_in_order(df: DataFrame, keys: list[str], order: str, bucket: Column, cols: list[str],
                 prefix: str = "prev_") -> DataFrame:
    """``lag(cols)`` over (keys ORDER BY order) without a per-key window.

    Inside a bucket the previous row comes from a window per (key, bucket); the
    first row of a bucket takes the last row of the nearest earlier non-empty
    bucket, found in a per-(key, bucket) table (one row per bucket).  ``order``
    must be unique within a key and ``bucket`` non-decreasing in it.
    """
    b = "__bucket"
    d = df.withColumn(b, _placed(bucket))
    w = Window.partitionBy(*keys, b).orderBy(order)
    inner = d.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols],
                     F.row_number().over(w).alias("__rn"))
    last = d.groupBy(*keys, b).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("__last"))
    prev_bucket = last.select(*keys, b, F.lag("__last").over(Window.partitionBy(*keys).orderBy(b)).alias("__pb"))
    joined = inner.join(prev_bucket, [*keys, b], "left")
    return joined.select(*[F.col(c) for c in df.columns],
                         *[F.when(F.col("__rn") == 1, F.col("__pb")[c]).otherwise(F.col(prefix + c)).alias(prefix + c)
                           for c in cols])
