"""Evaluation of many methods over many families in one plan, without a loop over families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.checks import fail_on, lookup, reconcile, validate_family_sets
from quillon.operators.evaluation import adjusted_rand, candidate_choice, dbscan_scores, method_summary, noise_report
from quillon.session import settled
from quillon.sources import readers
from quillon.sources.writers import write_dataframe

#: Rules and cutoffs of the compared methods, and the headline column of each method (fixed values).
SEQUENCE_RULES = ["80", "90", "95"]
TREE_CUTOFFS = ["0.02", "0.03", "0.04", "0.05", "0.06", "0.07", "0.08"]
METHODS = {
    "sequence_80_ARI": "Sequence similarity (rule 80)",
    "tree_0.02_ARI": "Phylogenetic tree (cutoff 0.02)",
    "dbscan_ARI": "DBSCAN (eps 0.1)",
    "umap_silhouette_ARI": "UMAP + K-means (silhouette k)",
    "spectral_silhouette_ARI": "Spectral (silhouette k)",
    "recursive_k2_ARI": "Recursive Spectral (repeated k=2)",
    "recursive_silhouette_ARI": "Recursive Spectral (silhouette)",
}
KEYS = ["family", "sequence_id"]


def check_truth(truth: DataFrame, ids: DataFrame) -> None:
    fail_on(reconcile(ids, truth, KEYS), "matrix and annotation IDs differ")


def check_outputs(truth: DataFrame, outputs: DataFrame, name: str, label: str, saved: str | None = None) -> None:
    """The same ids, no missing labels, and the known labels that were saved with them unchanged."""
    fail_on(reconcile(truth, outputs, KEYS), f"{name} IDs differ from the truth")
    fail_on(outputs.filter(F.col(f"`{label}`").isNull()).select(*KEYS), f"{name} has missing labels")
    if saved:
        fail_on(truth.join(outputs, KEYS).filter(~F.col("known_subfamily").eqNullSafe(F.col(saved))).select(*KEYS), f"{name} known labels differ")


def join_outputs(truth: DataFrame, outputs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """truth with a method's outputs, by one key, so that several such joins share its partitioning."""
    return truth.join(outputs, keys or KEYS)


def _scores(rows: DataFrame, prefix: str, variants: list[str]) -> DataFrame:
    """ARI and cluster count of each family and variant from long rows (family, known_subfamily, variant, label), wide."""
    long = adjusted_rand(rows, "known_subfamily", "label", ["family", "variant"]).join(rows.groupBy("family", "variant").agg(F.count_distinct("label").alias("clusters")), ["family", "variant"])
    name = lambda v, s: "_".join(x for x in (prefix, v, s) if x)
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return long.groupBy("family").agg(*[x for v in variants for x in (pick(v, "adjusted_rand_index").alias(name(v, "ARI")), pick(v, "clusters").alias(name(v, "clusters")))])


def _long(table: DataFrame, variants: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"`{v}`").cast("string").alias("label")) for v in variants]))
    return table.withColumn("_v", pairs).select("family", "known_subfamily", "_v.variant", "_v.label")


def family_comparison(truth: DataFrame, metadata: DataFrame, sequence: DataFrame, tree: DataFrame, dbscan: DataFrame, umap: DataFrame, spectral: DataFrame, recursive_k2: DataFrame, recursive_silhouette: DataFrame) -> DataFrame:
    """One row for each family: sizes, and the scores of all methods.

    truth: (family, sequence_id, known_subfamily); label tables have (family, sequence_id, ...); umap and spectral are
    candidate scores by k. Truth is joined to each label table by one key, so the joins share their partitioning.
    """
    base = lookup(truth.groupBy("family").agg(F.count("*").alias("n_sequences"), F.count_distinct("known_subfamily").alias("known_cluster_number")), metadata, "family", "family metadata lacks families")
    labelled = lambda t: join_outputs(truth, t)
    db = labelled(dbscan).withColumn("cluster_number", F.col("cluster_number").cast("double").cast("int")).select("family", "sequence_id", "known_subfamily", "cluster_number")
    noise = noise_report(db, "cluster_number", ["family"]).select("family", F.col("noise_count").alias("dbscan_noise_count"), F.col("noise_rate").alias("dbscan_noise_rate"), F.col("predicted_clusters_excluding_noise").alias("dbscan_clusters"))
    policies = dbscan_scores(db, "known_subfamily", "cluster_number", ["family"])
    policies = policies.select("family", F.col("noise_single_label_ARI").alias("dbscan_noise_single_label_ARI"), F.col("noise_unique_ARI").alias("dbscan_ARI"), F.col("noise_unique_ARI").alias("dbscan_noise_unique_ARI"), F.col("noise_removed_ARI").alias("dbscan_noise_removed_ARI"))
    u, s = candidate_choice(umap, ["family"]), candidate_choice(spectral, ["family"])
    u = u.select("family", F.col("silhouette_ari").alias("umap_silhouette_ARI"), F.col("silhouette_k").alias("umap_silhouette_k"), F.col("silhouette_value").alias("umap_silhouette_value"))
    s = s.select("family", F.col("silhouette_ari").alias("spectral_silhouette_ARI"), F.col("silhouette_k").alias("spectral_silhouette_k"), F.col("silhouette_value").alias("spectral_silhouette_value"), F.col("upper_ari").alias("spectral_upper_ARI"), F.col("upper_k").alias("spectral_upper_k"))
    one = lambda t, p: _scores(labelled(t).select("family", "known_subfamily", F.lit("").alias("variant"), F.col("cluster_number").cast("string").alias("label")), p, [""])
    parts = [base, _scores(_long(labelled(sequence), SEQUENCE_RULES), "sequence", SEQUENCE_RULES), _scores(_long(labelled(tree), TREE_CUTOFFS), "tree", TREE_CUTOFFS), noise, policies, u, s, one(recursive_k2, "recursive_k2"), one(recursive_silhouette, "recursive_silhouette")]
    return reduce(lambda x, y: x.join(y, "family"), parts)


def evaluate_dataset(spark: SparkSession, paths: dict[str, str], out: str | None = None, expected_families: int | None = None, family_output: str | None = None, method_output: str | None = None) -> dict[str, DataFrame]:
    """Reads the ten inputs (folders by method, annotation, matrix, family_metadata file), checks and evaluates them.

    The two tables go to the files family_output and method_output, or by their own names to the folder out.
    """
    glob = lambda name: f"{paths[name]}/*.csv"
    families = readers.numeric_csv_families(spark, paths["matrix"])
    names = ["sequence", "tree", "dbscan", "umap", "spectral", "recursive_k2", "recursive_silhouette", "annotation"]
    validate_family_sets(families, {n: readers.numeric_csv_families(spark, paths[n]) for n in names}, expected_families)
    ids = readers.read_matrix_ids(spark, glob("matrix")).join(families, "family", "left_semi")
    truth = settled(readers.read_annotation(spark, glob("annotation")).join(families, "family", "left_semi"))
    check_truth(truth, ids)
    sequence = settled(readers.read_result_table(spark, glob("sequence"), ["subfamily", *SEQUENCE_RULES]))
    tree = settled(readers.read_result_table(spark, glob("tree"), TREE_CUTOFFS))
    check_outputs(truth, sequence, "sequence similarity", SEQUENCE_RULES[0], "subfamily")
    check_outputs(truth, tree, "phylogenetic tree", TREE_CUTOFFS[0])
    labels = {n: settled(readers.read_result_table(spark, glob(n), ["cluster_number", "known_cluster"])) for n in ("dbscan", "recursive_k2", "recursive_silhouette")}
    for n, t in labels.items():
        check_outputs(truth, t, n, "cluster_number", "known_cluster")
    comparison = settled(family_comparison(truth, readers.read_family_metadata(spark, paths["family_metadata"]), sequence, tree, labels["dbscan"], readers.read_candidate_scores(spark, glob("umap")), readers.read_candidate_scores(spark, glob("spectral")), labels["recursive_k2"], labels["recursive_silhouette"]))
    if comparison.count() != families.count():
        raise ValueError("the number of families changed during evaluation")
    summary = method_summary(comparison, METHODS)
    family_output, method_output = family_output or out and f"{out}/family_comparison.csv", method_output or out and f"{out}/method_summary.csv"
    if family_output:
        numbered = comparison.withColumn("family", F.col("family").cast("int"))
        write_dataframe(numbered, family_output, single=True)
    if method_output:
        write_dataframe(summary, method_output, single=True)
    return {"comparison": comparison, "summary": summary}
