"""Agreement of clusterings with known labels, and summaries of many of them.

All statistics come from one contingency aggregate, so tens of thousands of families are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.checks import align_labels, require_columns, validate_predictions


def _pairs(n: str) -> Column:
    return F.col(n) * (F.col(n) - 1) / 2


def _index(both: Column, left: Column, right: Column, n: Column) -> Column:
    """Hubert and Arabie 1985 from numbers of pairs: in one cell, in one group of either side, and of n members."""
    expected = left * right / F.when(n > 1, n * (n - 1) / 2)
    top = (left + right) / 2
    return F.when(n < 2, 1.0).when(top == expected, 1.0).otherwise((both - expected) / (top - expected))


def _cells(rows: DataFrame, truth: str, predicted: str, keys: list[str], weight: str | None = None) -> DataFrame:
    return rows.groupBy(*keys, truth, predicted).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def _joined(one: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    for other in others:
        one = one.join(other, keys) if keys else one.crossJoin(other)  # a row each
    return one


def adjusted_rand(rows: DataFrame, truth: str, predicted: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, n_sequences, adjusted_rand_index) from contingency counts.

    Two trivial partitions agree fully: a zero denominator gives 1. weight: how many members a row stands for.
    """
    cells = _cells(rows, truth, predicted, keys, weight)
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_pairs("n")).alias(name))
    both = cells.groupBy(*keys).agg(F.sum(_pairs("n")).alias("both"), F.sum("n").alias("n_sequences"))
    joined = _joined(both, [side(truth, "left"), side(predicted, "right")], keys)
    return joined.select(*keys, F.col("n_sequences").cast("long").alias("n_sequences"), _index(F.col("both"), F.col("left"), F.col("right"), F.col("n_sequences")).alias("adjusted_rand_index"))


def cluster_counts(rows: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    """Distinct labels on both sides; nulls are not labels."""
    return rows.groupBy(*keys).agg(F.count_distinct(predicted).alias("predicted_clusters"), F.count_distinct(truth).alias("known_subfamilies"))


def cluster_sizes(rows: DataFrame, keys: list[str], cluster: str = "cluster") -> DataFrame:
    """(keys, cluster, n)"""
    return rows.groupBy(*keys, cluster).agg(F.count("*").alias("n"))


def size_gate(sizes: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, pass_minimum_size, least) from (keys, cluster, n): whether all clusters hold `least` rows, and the smallest size."""
    return sizes.groupBy(*keys).agg(F.bool_and(F.col("n") >= least).alias("pass_minimum_size"), F.min("n").alias("least"))


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """Columns rounded half to even."""
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def evaluate_clustering(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """(family, n_sequences, predicted_clusters, known_subfamilies, adjusted_rand_index)

    predictions: (family, sequence_id, predicted_cluster); known: (family, sequence_id, known_subfamily).
    """
    validate_predictions(predictions)
    ids = predictions.select("family", "sequence_id", F.lit(0).alias("ord"))
    truth = align_labels(known.select("family", "sequence_id", "known_subfamily"), ids).drop("ord")
    both = truth.join(predictions.select("family", "sequence_id", "predicted_cluster"), ["family", "sequence_id"])
    return adjusted_rand(both, "known_subfamily", "predicted_cluster", ["family"]).join(cluster_counts(both, "known_subfamily", "predicted_cluster", ["family"]), "family").select("family", "n_sequences", "predicted_clusters", "known_subfamilies", "adjusted_rand_index")


def unique_noise(rows: DataFrame, predicted: str, keys: list[str], order: str, noise: int = -1) -> DataFrame:
    """predicted, with each noise row a cluster of its own, numbered on from the largest label (from 0 without any)."""
    part = Window.partitionBy(*keys)
    is_noise = F.col(predicted) == noise
    start = F.coalesce(F.max(F.when(~is_noise, F.col(predicted))).over(part) + 1, F.lit(0))
    number = F.row_number().over(Window.partitionBy(*keys, "_noise").orderBy(order)) - 1
    return rows.withColumn("_noise", is_noise).withColumn(predicted, F.when(is_noise, start + number).otherwise(F.col(predicted))).drop("_noise")


def noise_report(rows: DataFrame, predicted: str, keys: list[str], noise: int = -1) -> DataFrame:
    is_noise = F.col(predicted) == noise
    return rows.groupBy(*keys).agg(F.count("*").alias("n_sequences"), F.count_distinct(F.when(~is_noise, F.col(predicted))).alias("predicted_clusters_excluding_noise"), F.count_if(is_noise).alias("noise_count"), F.avg(is_noise.cast("double")).alias("noise_rate"))


def dbscan_scores(rows: DataFrame, truth: str, predicted: str, keys: list[str], noise: int = -1) -> DataFrame:
    """Three readings of noise: one label; each row its own; removed (null with fewer than two rows left).

    All come from one contingency table: a cluster of one row has no pairs, so noise read row by row only drops out of the pairs
    in cells and in predicted clusters, and removed noise drops out of those in known groups too.
    """
    cells = _cells(rows, truth, predicted, keys).withColumn("m", F.when(F.col(predicted) != noise, F.col("n")).otherwise(0))
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).groupBy(*keys).agg(F.sum(_pairs("n")).alias(name), F.sum(_pairs("m")).alias(f"kept_{name}"))
    both = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(_pairs("n")).alias("both"), F.sum(_pairs("m")).alias("kept_both"))
    c = F.col
    single = _index(c("both"), c("left"), c("right"), c("n"))
    unique = _index(c("kept_both"), c("left"), c("kept_right"), c("n"))
    kept = F.when(c("m") >= 2, _index(c("kept_both"), c("kept_left"), c("kept_right"), c("m")))
    joined = _joined(both, [side(truth, "left"), side(predicted, "right")], keys)
    return joined.select(*keys, single.alias("noise_single_label_ARI"), unique.alias("noise_unique_ARI"), kept.alias("noise_removed_ARI"))


def evaluate_dbscan_with_unique_noise(predictions: DataFrame, known: DataFrame, *, noise_label: int = -1) -> DataFrame:
    """(family, n_sequences, predicted_clusters_excluding_noise, noise_count, noise_rate, adjusted_rand_index), each noise row its own cluster."""
    validate_predictions(predictions)
    ids = predictions.select("family", "sequence_id", F.lit(0).alias("ord"))
    truth = align_labels(known.select("family", "sequence_id", "known_subfamily"), ids).drop("ord")
    both = truth.join(predictions.select("family", "sequence_id", "predicted_cluster"), ["family", "sequence_id"])
    score = dbscan_scores(both, "known_subfamily", "predicted_cluster", ["family"], noise_label).select("family", F.col("noise_unique_ARI").alias("adjusted_rand_index"))
    return noise_report(both, "predicted_cluster", ["family"], noise_label).join(score, "family")


def candidate_choice(scores: DataFrame, keys: list[str], k: str = "k", silhouette: str = "mean_silhouette", ari: str = "adjusted_rand_index") -> DataFrame:
    """The k of the largest silhouette, and of the largest index; of equal ones the least k; NaN and null never win."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    first = lambda c: F.max_by(F.struct(k, silhouette, ari), F.when(known(c).isNotNull(), F.struct(known(c), -F.col(k))))
    best = scores.groupBy(*keys).agg(first(silhouette).alias("s"), first(ari).alias("u"))
    return best.select(*keys, F.col(f"s.{k}").alias("silhouette_k"), F.col(f"s.{silhouette}").alias("silhouette_value"), F.col(f"s.{ari}").alias("silhouette_ari"), F.col(f"u.{k}").alias("upper_k"), F.col(f"u.{ari}").alias("upper_ari"))


def method_long(results: DataFrame, methods: dict[str, str]) -> DataFrame:
    """One row for each family and method: (.., method, ari). methods: names by score column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(f"`{c}`").cast("double").alias("ari")) for c, n in methods.items()]))
    return results.withColumn("_m", pairs).select("*", "_m.method", "_m.ari").drop("_m")


def summarize_methods(results: DataFrame, methods: dict[str, str], *, subset_name: str, digits: int | None = None) -> DataFrame:
    """(subset, method, n_families, mean_ARI, sequence_weighted_mean_ARI, median_ARI, Q1, Q3, ARI_ge_0.9, ARI_lt_0.5)

    Families without a score don't count, but make the weighted mean null. Quantiles are interpolated.
    """
    require_columns(results, "n_sequences", *methods)
    a = F.when(~F.isnan("ari"), F.col("ari"))
    weighted = F.when(F.count_if(a.isNull()) == 0, F.sum(a * F.col("n_sequences")) / F.sum("n_sequences"))
    out = method_long(results, methods).groupBy("method").agg(
        F.count(a).alias("n_families"),
        F.avg(a).alias("mean_ARI"),
        weighted.alias("sequence_weighted_mean_ARI"),
        F.percentile(a, 0.5).alias("median_ARI"),
        F.percentile(a, 0.25).alias("Q1"),
        F.percentile(a, 0.75).alias("Q3"),
        F.count_if(a >= 0.9).alias("ARI_ge_0.9"),
        F.count_if(a < 0.5).alias("ARI_lt_0.5"),
    )
    if digits is not None:
        out = rounded(out, ["mean_ARI", "sequence_weighted_mean_ARI", "median_ARI", "Q1", "Q3"], digits)
    return out.select(F.lit(subset_name).alias("subset"), *[F.col(f"`{c}`") for c in out.columns])


def method_summary(comparison: DataFrame, methods: dict[str, str], digits: int | None = 4) -> DataFrame:
    """The summary over all families, those with several known groups, and those of these that are TE."""
    several = comparison.filter("known_cluster_number > 1")
    subsets = [("all families", comparison), ("known k > 1", several), ("known k > 1 and TE", several.filter("TE = 'TE'"))]
    out = None
    for name, rows in subsets:
        one = summarize_methods(rows, methods, subset_name=name, digits=digits)
        out = one if out is None else out.unionByName(one)
    return out
