"""Global order without a single task: literal bounds of a key, windows inside the ranges, offsets from range totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys looked at to place the bounds, about, and ranges.  Bounds only balance the ranges; results do not depend on them.
SAMPLE, RANGES = 10_000, 200


def range_of(df: DataFrame, key: str) -> Column:
    """Number of the range a key falls in: ascending in the key, equal keys together, nulls first."""
    n = df.count()
    share = min(1.0, SAMPLE / n) if n else 1.0
    picked = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).select(key).where(F.col(key).isNotNull()).collect())
    bounds = sorted({picked[i * len(picked) // RANGES] for i in range(RANGES)} if picked else set())
    return F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)


def _before(df: DataFrame, value: Column) -> DataFrame:
    """_range and the sum of value over all ranges before it (one row per range)."""
    totals = df.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, key: str, out: str = "rid") -> DataFrame:
    """Adds 0.. in the order of a key (unique, or ties in any order): a window per range, no row leaves the JVM."""
    x = df.withColumn("_range", range_of(df, key))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return x.withColumn("_inside", inside).join(F.broadcast(_before(x, F.lit(1))), "_range").select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(out))


def running_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds the sum of value over all rows of a smaller key (unique), 0 for the first."""
    x = df.withColumn("_range", range_of(df, key))
    earlier = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return x.withColumn("_inside", inside).join(F.broadcast(_before(x, F.col(value))), "_range").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def quantile(df: DataFrame, key: str, p: float) -> DataFrame:
    """One row: the exact quantile of a numeric column, interpolated between neighbours; no task holds all values."""
    known = df.where(F.col(key).isNotNull()).select(key)
    n = known.count()
    place = p * max(0, n - 1)
    low = int(place)
    near = numbered(known, key).where(F.col("rid").between(low, low + 1))
    first, second = (F.max(F.when(F.col("rid") == low + i, F.col(key))) for i in (0, 1))
    return near.agg((first + (place - low) * (F.coalesce(second, first) - first)).alias("quantile"))


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """n rows (of each group) in the order of a hash of keys and seed: the same rows on every run and layout."""
    h = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))
    if not by:
        return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(h, *keys))).where(F.col("_n") <= n).drop("_n")
