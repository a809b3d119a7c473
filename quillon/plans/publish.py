"""Publishing a family under neutral names, and proving that nothing else changed.

All three files are joined on the canonical id; order is the distance file's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import canonical_id
from quillon.operators.checks import fail_on, require_columns, validate_sequence_ids
from quillon.session import settled
from quillon.sources import readers, writers

ANNOTATION_COLUMNS = ("name", "subfamily", "subfamily_ID", "used")


def _load(spark: SparkSession, family: str, mldist: str, alignment: str, annotation: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges with the distances' text, ids, alignment, labels), under the original canonical ids."""
    edges = settled(readers.scan_mldist(spark, mldist, family))
    ids = edges.filter("i = j").select("family", F.col("i").alias("ord"), F.col("src").alias("sequence_id"))
    msa = settled(readers.scan_fasta(spark, alignment, family).withColumn("sequence_id", canonical_id("sequence_id")))
    validate_sequence_ids(ids, ("alignment", msa))
    table = spark.read.csv(annotation, header=True)
    require_columns(table, *ANNOTATION_COLUMNS)
    used = readers.annotation_used(table)
    fail_on(used.groupBy("sequence_id").count().filter("count > 1").select("sequence_id"), "annotation repeats IDs in use")
    fail_on(ids.join(used, "sequence_id", "left_anti").select("sequence_id"), "annotation lacks sequence IDs")
    return edges, ids, msa, settled(ids.join(used, "sequence_id"))


def prepare_example(spark: SparkSession, family: str, mldist: str, alignment: str, annotation: str, out: str, facts: dict | None = None) -> None:
    """Writes distances, alignment, labels and metadata under numbered names; no mapping is written."""
    edges, ids, msa, labels = _load(spark, family, mldist, alignment, annotation)
    names = settled(writers.public_names(ids, family))
    writers.write_mldist(edges, f"{out}/pairwise_ml_distance.mldist", names)
    renamed = msa.join(names, "sequence_id").select("ord", F.col("public_id").alias("sequence_id"), "seq")
    writers.write_fasta(renamed, f"{out}/alignment.fasta")
    public = labels.join(names, "sequence_id").orderBy("ord").select(F.col("public_id").alias("sequence_id"), "known_subfamily")
    writers.write_dataframe(public, f"{out}/labels.csv", single=True)
    counts = {r[0]: r[1] for r in labels.groupBy("known_subfamily").count().orderBy("known_subfamily").collect()}
    writers.write_json({"family_id": int(family), **(facts or {}), "sequence_count": ids.count(), "known_subfamily_counts": counts}, f"{out}/metadata.json")


def verify_example(spark: SparkSession, family: str, mldist: str, alignment: str, annotation: str, public: str) -> None:
    """Raises unless the published files are the originals but for names."""
    edges, ids, msa, labels = _load(spark, family, mldist, alignment, annotation)
    names = settled(writers.public_names(ids, family))
    after = readers.scan_mldist(spark, f"{public}/pairwise_ml_distance.mldist", family)
    fail_on(writers.renaming_faults(edges.select("i", "j", "src", "dst", "distance_text"), after.select("i", "j", "src", "dst", "distance_text"), names, ["src", "dst"]), "published distances differ")
    sequences = readers.scan_fasta(spark, f"{public}/alignment.fasta", family).select("ord", "sequence_id", "seq")
    fail_on(writers.renaming_faults(msa.select("ord", "sequence_id", "seq"), sequences, names, ["sequence_id"]), "published sequences differ")
    known = readers.read_labels(spark, f"{public}/labels.csv", family).select("ord", "sequence_id", "known_subfamily")
    fail_on(writers.renaming_faults(labels.select("ord", "sequence_id", "known_subfamily"), known, names, ["sequence_id"]), "published labels differ")
