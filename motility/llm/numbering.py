"""Gapless global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motility.llm.common import fresh, named, quoted

#: Leading hexadecimal digits of an MD5 sum: 4096 buckets, about even for any keys.
DIGITS = 3


def md5_bucket(*keys: Column, digits: int = DIGITS) -> Column:
    """A bucket that depends on the keys alone. Give all that rows are ordered by, so that no single id makes a bucket hot."""
    return F.substring(F.md5(F.concat_ws(",", *(k.cast("string") for k in keys)).cast("binary")), 1, digits)


def numbered(df: DataFrame, bucket: str, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Adds ``name``: 0, 1, 2 ... over all rows, by ``bucket`` and, in a bucket, by ``order``; also returns the number of rows.

    ``bucket`` is a column with few thousand values at most: only their counts are added up in one place. Rows that
    tie in ``order`` are numbered in any order. The input is read twice, so it should be cheap to read or written.
    Other columns are kept, but for one called ``name``, which is replaced.
    """
    n, b, before, local = fresh(df.columns, "n", "b", "before", "local")
    sizes = df.groupBy(quoted(bucket)).agg(F.count("*").alias(n))
    sums = F.sum(n).over(Window.orderBy(quoted(bucket)).rowsBetween(Window.unboundedPreceding, -1))
    total = sizes.agg(F.sum(n)).first()[0] or 0
    begins = sizes.select(F.col(quoted(bucket)).alias(b), F.coalesce(sums, F.lit(0)).cast("long").alias(before))
    place = F.row_number().over(Window.partitionBy(quoted(bucket)).orderBy(*map(quoted, order)))
    out = df.withColumn(local, place).join(F.broadcast(begins), F.col(quoted(bucket)) == F.col(b))
    return out.select(*named(c for c in df.columns if c != name), (F.col(before) + F.col(local) - 1).alias(name)), total
