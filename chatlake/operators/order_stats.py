"""Order statistics, histograms and top-k, exact and without gathering values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.running import beside, blocked_running_sum

VALUE_BLOCK = 4096


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """value, n, before: distinct values with their count and the number of smaller values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return blocked_running_sum(counts.withColumn("block", F.floor(F.col("value") / VALUE_BLOCK)), [], "block", ["value"], {"before": "n"})


def percentiles(rows: DataFrame, value: str, points: list[int], prefix: str = "p") -> DataFrame:
    """One row: count, min, max, median and the lower-nearest percentiles at ``points``.

    The p-th is the element at index floor(p/100 * (n-1)) of the sorted values; the median of an even number is the mean
    of the middle two. Values are counted first, so any number of rows reduces to the distinct values. No rows: count 0,
    median and percentiles 0.
    """
    ranked = _ranked(rows, value)
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    at = ranked.transform(beside, total)  # total is one row

    def element(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("value")))

    zero = F.lit(0)
    middle = (element(F.floor((F.col("total") - 1) / 2)) + element(F.floor(F.col("total") / 2))) / 2
    out = at.agg(F.coalesce(F.sum("n"), zero).alias("count"), F.coalesce(F.min("value"), zero).alias("min"), F.coalesce(F.max("value"), zero).alias("max"), F.coalesce(middle, zero.cast("double")).alias("median"), *[F.coalesce(element(F.floor(F.lit(p / 100.0) * (F.col("total") - 1))), zero).alias(f"{prefix}{p}") for p in points])
    return out


def kth_smallest(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k-th smallest value from 0; no row if k is out of range."""
    return _ranked(rows, value).where((F.col("before") <= k) & (F.lit(k) < F.col("before") + F.col("n"))).select("value")


def time_histogram(rows: DataFrame, time: str, bucket: int) -> DataFrame:
    """bucket_start, count: buckets aligned to the smallest time, zero-filled to the largest. No rows: no buckets."""
    known = rows.where(F.col(time).isNotNull())
    span = known.agg(F.min(time).alias("low"), F.max(time).alias("high")).where("low is not null")
    counted = known.transform(beside, span).groupBy((F.col("low") + F.floor((F.col(time) - F.col("low")) / bucket) * bucket).alias("bucket_start")).agg(F.count("*").alias("count"))
    spine = span.select(F.explode(F.sequence("low", "high", F.lit(bucket).cast("long"))).alias("bucket_start"))
    return spine.join(counted, "bucket_start", "left").select("bucket_start", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def bucketed(rows: DataFrame, time: str, bucket: int, start: int, end: int, order: str = "id") -> DataFrame:
    """Rows of [start, end] with bucket_no and their place in the bucket; rows outside are dropped, ties keep the order of ``order``."""
    inside = rows.where(F.col(time).between(start, end)).withColumn("bucket_no", F.floor((F.col(time) - start) / bucket))
    numbered = blocked_running_sum(inside.withColumn("block", F.floor(F.col(order) / VALUE_BLOCK)), ["bucket_no"], "block", [order], {"before": F.lit(1)})
    return numbered.withColumn("place", F.col("before") + 1).drop("before", "block")


def most_frequent(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value. Counting combines map-side, the top-k keeps k rows a task."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("count")).orderBy(F.desc("count"), value).limit(k)


def top_k(rows: DataFrame, field: str, k: int, largest: bool = True, tie: str = "id") -> DataFrame:
    """The k rows with the largest (or smallest) field; a missing field counts as 0, ties go by ``tie``."""
    key = F.coalesce(F.col(field), F.lit(0))
    return rows.orderBy(key.desc() if largest else key.asc(), tie).limit(k)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def has_more(total: int, limit: int, offset: int) -> bool:
    return offset + limit < total


def last_buckets(histogram: DataFrame, n: int) -> DataFrame:
    """The n latest buckets, in time order."""
    return histogram.orderBy(F.desc("bucket_start")).limit(n).orderBy("bucket_start")
