"""Running sums that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.session import settle


def blocked_running_sum(df: DataFrame, keys: list[str], block: str, order: list[str | Column], sums: dict[str, str | Column]) -> DataFrame:
    """Add, per ``keys`` in the order (``block``, ``order``), the sum of each of ``sums`` over all earlier rows.

    A window runs inside each (keys, block) group and a second one over the block totals only, so a group of any size is
    spread over as many tasks as it has blocks. ``keys`` and ``block`` must not be null; ``df`` is read twice, so settle it
    first if it is costly. Without ``keys`` the totals of all blocks meet in one task: give a bounded number of blocks.
    Ties in ``order`` get an arbitrary but consistent order.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    values = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    totals = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"__of_{n}") for n, c in values.items()])
    before = totals.select(*keys, block, *[F.coalesce(F.sum(f"__of_{n}").over(across), F.lit(0)).alias(f"__to_{n}") for n in values])
    local = df.withColumns({f"__in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()})
    joined = local.join(before, [*keys, block])
    return joined.withColumns({n: F.col(f"__in_{n}") + F.col(f"__to_{n}") for n in values}).drop(*[f"__{x}_{n}" for n in values for x in ("in", "to")])


def ranged_running_sum(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str | Column]) -> DataFrame:
    """Add, per ``keys`` in ``order``, the sum of each of ``sums`` over all earlier rows, by ranges of (``keys``, ``order``).

    The rows are cut into as many ranges as a shuffle has partitions, at bounds sampled from the rows themselves, so neither a
    hot key nor a burst of equal values makes a large group. Sums run inside each (range, key); a second window adds the totals
    of the earlier ranges, a row per range and key. Rows equal in ``keys`` and ``order`` get an arbitrary but consistent order.
    """
    ranged = settle(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order).withColumn("__range", F.spark_partition_id()))
    return blocked_running_sum(ranged, keys, "__range", order, sums).drop("__range")


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Each row with the columns of ``one``, the result of an aggregation without keys: a single row, so it is broadcast."""
    return rows.join(F.broadcast(one), F.lit(True))
