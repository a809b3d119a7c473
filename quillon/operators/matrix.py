"""Distance and affinity matrices as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import pairs
from quillon.operators.checks import fail_on


def number_members(points: DataFrame, family: str = "family", order: str = "sequence_id") -> DataFrame:
    """points with ord, from 0 within each family."""
    return points.withColumn("ord", F.row_number().over(Window.partitionBy(family).orderBy(order)) - 1)


def pairwise_distance(points: DataFrame) -> DataFrame:
    """All (i, j) within each family of (family, ord, sequence_id, vec), by pairs of blocks. Half are computed, and mirrored."""
    return pairs.cells(pairs.packed(points))


def family_maximum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("family").agg(F.max("distance").alias("maximum_distance"))


def distance_to_affinity(edges: DataFrame, checked: bool = True) -> DataFrame:
    """1 - d / max of the family, then a zero diagonal. The largest distance of a family must be positive."""
    top = family_maximum(edges)
    if checked:
        fail_on(top.filter("not maximum_distance > 0").select("family"), "maximum within-family distance must be greater than zero")
    scaled = F.when(F.col("i") == F.col("j"), 0.0).otherwise(1 - F.col("distance") / F.col("maximum_distance"))
    return edges.join(top, "family").select("family", "i", "j", "src", "dst", scaled.alias("affinity"))


def submatrix(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose two ends are both in members (family, sequence_id); values are not rescaled."""
    one = members.select("family", F.col("sequence_id").alias("src"))
    two = members.select("family", F.col("sequence_id").alias("dst"))
    return edges.join(one, ["family", "src"], "left_semi").join(two, ["family", "dst"], "left_semi").select(*edges.columns)


def degree(affinity: DataFrame) -> DataFrame:
    return affinity.groupBy("family", "i").agg(F.sum("affinity").alias("degree"))


def laplacian(affinity: DataFrame) -> DataFrame:
    """Entries of I - D^-1/2 W D^-1/2."""
    d = degree(affinity)
    both = affinity.join(d.withColumnRenamed("degree", "di"), ["family", "i"]).join(d.select("family", F.col("i").alias("j"), F.col("degree").alias("dj")), ["family", "j"])
    weight = F.col("affinity") / F.sqrt(F.col("di") * F.col("dj"))
    return both.select("family", "i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - weight).alias("laplacian"))
