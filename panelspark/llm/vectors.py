"""Tables of vectors as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 22  # whole components stand in [-MOST, MOST], so that sums of products fit a long


def usable(c: str) -> Column:
    """The vector is there and so are all its components, none of them infinite or not a number."""
    x = F.col(c)
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def whole(df: DataFrame, c: str, scale: int, multiple: int = 1) -> tuple[DataFrame, int]:
    """(df with the vector as whole numbers floor(scale * x), its dimension). The dimension is the size of the longest vector,
    rounded up to a multiple; shorter vectors get zeros at the end. Components beyond MOST are cut to it. A job for the size."""
    longest = df.agg(F.max(F.size(c)).alias("n")).first()["n"] or 0
    size = max(multiple, -(-longest // multiple) * multiple)
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))))
    return df.withColumn(c, F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size(c)))), size
