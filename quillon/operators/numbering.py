"""Ordinals by range: rows are dealt to tasks by their order, so no task numbers a whole table or family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import settled

BROADCAST_ROWS = 1 << 20


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """rows with `name`: 0, 1, ... within each of keys, by order, which tells a key's rows apart.

    The rows are sorted into ranges and kept, so that ranges can't change between counting and numbering. The driver
    sees a row for each range; a key's first number comes from an aggregate.
    """
    spark = rows.sparkSession
    kept = settled(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_mid", F.monotonically_increasing_id()))
    ranged = kept.withColumn("_range", F.shiftright("_mid", 33)).withColumn("_in", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid")
    start, offsets = 0, []
    for r in sorted(tuple(r) for r in ranged.groupBy("_range").count().collect()):
        offsets.append((r[0], start))
        start += r[1]
    placed = ranged.join(F.broadcast(spark.createDataFrame(offsets, "_range long, _offset long")), "_range").withColumn("_row", F.col("_offset") + F.col("_in")).drop("_range", "_in", "_offset")
    if not keys:
        return placed.withColumn(name, F.col("_row").cast("int")).drop("_row")
    first = settled(placed.groupBy(*keys).agg(F.min("_row").alias("_first")))
    return placed.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, keys).withColumn(name, (F.col("_row") - F.col("_first")).cast("int")).drop("_row", "_first")
