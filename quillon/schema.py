"""Table layouts. Matrices are edge tables: one row for each (i, j), never a column for each sequence."""

from __future__ import annotations

DISTANCE = "family string, i int, j int, src string, dst string, distance double"
AFFINITY = "family string, i int, j int, src string, dst string, affinity double"
LABELS = "family string, ord int, sequence_id string, known_subfamily string"
ALIGNMENT = "family string, ord int, sequence_id string, seq string"
ANNOTATION = "name string, subfamily string, subfamily_ID string, used string"
FAMILY_METADATA = "family_ID int, `order` string, TE string"
HITS = "Query string, Subject string, Identity double, Length int, Mismatches int, GapOpens int, QueryStart int, QueryEnd int, SubjectStart int, SubjectEnd int, Score double"

#: Columns of the recursive diagnostics, in their fixed order.
DIAGNOSTICS = (
    "family string, depth int, path string, n_sequences int, tested_k int, silhouette_score double, rank int, pass_minimum_size boolean, "
    "pass_similarity_threshold boolean, pass_layer_similarity boolean, pass_reassignment boolean, accepted boolean, rejection_reason string, "
    "upper_similarity double, reassignment_accuracy double, minimum_child_similarity double, maximum_child_similarity double, child_sizes string"
)
BINARY_DIAGNOSTICS = "family string, recursion_counter int, path string, n_sequences int, accepted boolean, rejection_reason string, consensus_similarity double, reassignment_accuracy double, child_sizes string"

#: What pandas-style readers take for a missing value (fixed values).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
