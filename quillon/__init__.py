"""Clustering analytics on Spark DataFrames: subgroup structure in many families of aligned sequences."""

from quillon.operators.evaluation import evaluate_clustering, evaluate_dbscan_with_unique_noise, summarize_methods
from quillon.operators.checks import validate_sequence_ids, validate_square_matrix
from quillon.operators.clustering import RecursiveResult, SpectralResult, run_spectral_clustering
from quillon.operators.matrix import distance_to_affinity
from quillon.operators.recursion import FixedBinaryConfig, RecursiveConfig, run_fixed_binary_recursive, run_recursive_clustering
from quillon.sources.readers import read_alignment, read_labels, read_matrix_csv, read_mldist
from quillon.sources.writers import write_dataframe

__all__ = [
    "FixedBinaryConfig",
    "RecursiveConfig",
    "RecursiveResult",
    "SpectralResult",
    "distance_to_affinity",
    "evaluate_clustering",
    "evaluate_dbscan_with_unique_noise",
    "read_alignment",
    "read_labels",
    "read_matrix_csv",
    "read_mldist",
    "run_fixed_binary_recursive",
    "run_recursive_clustering",
    "run_spectral_clustering",
    "summarize_methods",
    "validate_sequence_ids",
    "validate_square_matrix",
    "write_dataframe",
]
