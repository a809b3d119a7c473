"""How well several ways of grouping the members of many families agree with known labels.

    python -m jobs.method_report --config jobs/method_report.json --documents D --labels L --output OUT

Reads documents and labels, takes each of `methods` (name: SQL expression over documents) as a clustering of every family's labelled
members, and scores it against the known labels: a row for each family and method in OUT/scores, partitioned by
method; their distribution over all families, and over those with several known groups, in OUT/summary, partitioned by subset.

A run replaces the partitions of the methods that it scores and leaves those of others, so it can be repeated, and
one method can be added without the rest. All is aggregates by family, method and group: no group meets in one task.
A null family is the family "?"; a null group or label is a group of its own; documents without a label are counted and left out.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.command import main
from quillon.operators import checks, evaluation

LOG = logging.getLogger("method_report")
SCORES = "family string, n_sequences long, predicted_clusters long, known_subfamilies long, adjusted_rand_index double, method string"
SUMMARY = "method string, n_families long, mean_ARI double, sequence_weighted_mean_ARI double, median_ARI double, Q1 double, Q3 double, `ARI_ge_0.9` long, `ARI_lt_0.5` long, subset string"


def score(docs: DataFrame, labels: DataFrame, methods: dict[str, str], family: str, known: str) -> DataFrame:
    """SCORES from documents and labels of the same ids."""
    truth = labels.select("doc_id", F.expr(known).cast("string").alias("known_subfamily"))
    ways = F.array(*[F.struct(F.lit(name).alias("method"), F.expr(how).cast("string").alias("cluster")) for name, how in methods.items()])
    told = docs.select("doc_id", F.coalesce(F.expr(family).cast("string"), F.lit("?")).alias("family"), F.explode(ways).alias("m"))
    rows = told.join(truth, "doc_id").select("family", "m.method", "m.cluster", "known_subfamily")
    # groups are counted once; what follows sees a row for each family, method, group and label
    cells = rows.groupBy("family", "method", "known_subfamily", "cluster").agg(F.count("*").alias("n"))
    index = evaluation.adjusted_rand(cells, "known_subfamily", "cluster", ["family", "method"], "n")
    groups = evaluation.cluster_counts(cells, "known_subfamily", "cluster", ["family", "method"])
    return index.join(groups, ["family", "method"]).select(*[c.strip().split(" ")[0] for c in SCORES.split(",")])


def summaries(scores: DataFrame, methods: dict[str, str]) -> DataFrame:
    """SUMMARY of scores."""
    wide = scores.groupBy("family").agg(F.max("n_sequences").alias("n_sequences"), F.max("known_subfamilies").alias("known"), *[F.max(F.when(F.col("method") == m, F.col("adjusted_rand_index"))).alias(m) for m in methods])
    names = {m: m for m in methods}
    every = evaluation.summarize_methods(wide, names, subset_name="all families")
    several = evaluation.summarize_methods(wide.filter("known > 1"), names, subset_name="known k > 1")
    return every.unionByName(several)


def run(spark: SparkSession, documents: str, labels: str, output: str, methods: dict[str, str], family: str = "source", known: str = "quality") -> DataFrame:
    """Reads, scores, writes; gives back the scores with the summaries of their methods, as read from output."""
    seen, wrote = Observation(), Observation()
    docs = spark.read.parquet(documents).observe(seen, F.count("*").alias("rows"))
    given = spark.read.parquet(labels).filter(f"doc_id is not null and {known} is not null")
    checks.fail_on(checks.duplicate_ids(given, "doc_id").select("doc_id"), "documents with several labels")
    put = lambda df, table, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{output}/{table}")
    put(score(docs, given, methods, family, known).repartition("method").observe(wrote, F.count("*").alias("rows"), F.sum("n_sequences").alias("members")), "scores", "method")
    scores = spark.read.schema(SCORES).parquet(f"{output}/scores")
    mine = scores.filter(F.col("method").isin(*methods))
    put(summaries(mine, methods), "summary", "subset")
    LOG.info("read %s documents from %s and labels from %s", seen.get["rows"], documents, labels)
    LOG.info("wrote %s scores of %s methods, over %s labelled members, to %s", wrote.get["rows"], len(methods), (wrote.get["members"] or 0) // max(1, len(methods)), output)
    summary = spark.read.schema(SUMMARY).parquet(f"{output}/summary")
    return mine.join(F.broadcast(summary), "method")


if __name__ == "__main__":
    main("method_report", __doc__, run, ("documents", "labels", "output"))
