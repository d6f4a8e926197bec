"""Joins of all rows with all rows, dealt out in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(left: DataFrame, right: DataFrame, on: tuple[str, ...] = (), rows: tuple[int, int] = (1 << 10, 1 << 12)) -> DataFrame:
    """Every left row (alias a) with every right row (alias b) that has the same ``on``.

    For rules that ask for all pairs. Both sides are dealt into blocks, and a pair
    of blocks is a key of an equi-join: neither side is broadcast, no task gets more
    than its tiles, and a frequent value of ``on`` is many tiles. The number of
    partitions is given, as few bytes stand for many pairs here and would be put
    together into one task.
    """
    wide, high = (max(1, -(-df.count() // n)) for df, n in zip((left, right), rows, strict=True))
    deal = lambda df, n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    l = left.withColumn("_x", deal(left, wide)).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    r = right.withColumn("_y", deal(right, high)).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    parts = min(wide * high, 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = lambda df: df.withColumn("_tile", F.col("_x") * high + F.col("_y")).drop("_x", "_y").repartition(max(parts, 1), "_tile", *on)
    a, b = at(l).alias("a").hint("merge"), at(r).alias("b")
    same = F.col("a._tile") == F.col("b._tile")
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same)
