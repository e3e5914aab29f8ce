"""Positions in a total order without a single-task sort.

Rows get a bucket that is monotone in the order. Sums by bucket give each bucket's
offset, and a window inside the bucket gives the rest. Only the table of buckets is
ever put in one order; its size is rows / rows-per-bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4_000


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // rows_per_bucket))


def hex_fraction_bucket(key: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a hex digest, monotone in the digest."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(buckets) / F.lit(float(2**32))).cast("long")


def shuffle_key(seed: int, row_id: Column, text: Column) -> Column:
    """A hex digest that puts rows in a seeded random order; null and repeated ids are told apart by their texts."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))


def with_positions(df: DataFrame, keys: list[str], bucket: str, order: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``before`` (sum of weights of the rows before, by ``order`` within ``keys``)
    and ``in_all`` (sum of weights of the key). Keys and bucket hold no null."""
    w = F.col(weight) if weight else F.lit(1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(w).cast("long").alias("_sum"))
    by = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_sum").over(by.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(by).alias("in_all"),
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    if weight:
        within = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        within = F.row_number().over(inside) - 1
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn("before", (F.col("_offset") + within).cast("long"))
        .drop("_offset")
    )
